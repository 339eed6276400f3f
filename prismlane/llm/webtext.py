"""Main text of web pages by wrapper induction.

Each page is parsed into a tree of block elements in which neighbours of one kind (tag and class) are one node. The commonest
tree of a host is its reference; every page's tree is aligned with it by simple tree matching (memoised by shape, so one
alignment serves all pages of a shape), whatever its size or depth. A block text that stands at one aligned node on CONSTANT of a host's pages, MIN_PAGES at
least, belongs to the template; blocks that vary are content, if they lie in article or main (in body where a page has neither)
and not in an element, block or inline, whose tag, role, class or id marks a menu, header, footer, sidebar, notice, advert, form or
comment. Inside the main part a name counts only if all its words are such marks or say nothing (share-button, not search-history);
article and main are never dropped for a name, but an article named like a comment or advert gives way to others of its page.
Where every content block of a page is constant the page is a copy of another and keeps them.

Tags are read as the HTML standard's tokenizer does, each character a bounded number of times: quotes count only in values, and a
tag, comment or declaration that never ends takes the rest of the page. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by one \\n. A null or empty html, or one without content, gives ''. No page
is cut, none is treated otherwise for its size. A null url, or one without a host, is a host of its own, ''. Rows are judged alone
against their host's template, so repeated rows agree; they count as pages of the host. An empty table gives no rows.
Only shapes and 8-byte hashes are exchanged, summed up before; a host's template holds at most 1/CONSTANT times its mean number
of blocks (8 bytes each), and pages meet it by host in a join whose small side Spark broadcasts only below its measured size threshold.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

store.by_value(__name__)

CONSTANT, MIN_PAGES = 0.6, 3
_ATTRS = r"""(?:[\s/]*+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+[\s/]*+"""
#: A whole tag that needs no repair; `=` with nothing to name, and quotes that never close, are left to _repaired.
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>")
_ATTR = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>|\Z)))?+""")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_COMMENT_END = re.compile("--!?>")
_QUOTE = re.compile(r"\s*+=\s*+[\"']")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_HOLD = {"ul", "ol", "table", "dl", "article", "body", "main", "div", "section"}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "head"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "status"}
#: Parts of class names and ids that mark what is not the article.
_CHROME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "dropdown",
    "feedback", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "paywall", "popup",
    "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Of these, names that the article's own title block may bear.
_TITLE_NAMES = {"banner", "header", "masthead"}
#: Beginnings of longer names of the same kinds, like commentlist or topnav.
_CHROME_STARTS = re.compile(r"^(?:ad(?:box|slot|unit|banner|container|wrapper)|advert|breadcrumb|comment|cookie|disqus|footer|header|menu|nav(?:bar|igation|menu|links)|newsletter|popup|sidebar|sponsor|subscri|topnav|sidenav|mainnav|sitenav)")
#: Words of a name that say nothing of what it holds.
_NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "container", "content", "count", "div", "field", "foot", "group", "head", "heading", "icon", "icons", "in", "inline",
    "inner", "item", "items", "label", "left", "link", "links", "list", "main", "module", "outer", "panel", "right", "row", "section", "site", "slot", "text", "title", "toggle", "top", "unit", "up", "wrap", "wrapper",
}
_PARTS = re.compile(r"[^a-z]+")
_NODE = re.compile(r"([(,]?)([^(),]+)(\)*)")
_LAYOUT = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_][\w-]*+")


def _marks(word: str) -> bool:
    return word in _CHROME_NAMES or _CHROME_STARTS.match(word) is not None


def _facts(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    """Kind of element, whether it marks non-content outside and inside of the main part, and its main part: 0 none, 1 doubtful, 2 sure."""
    return _judged_once(tag, attrs) if len(attrs) < 400 else _judged(tag, attrs)


def _judged(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        found.setdefault(k.lower(), _html.unescape(v.strip("\"'")).lower())
    label, role = re.sub(r"[(),]", "_", tag), found.get("role", "")
    first = re.sub(r"\d+", "#", re.split(r"[(),.\s]", found.get("class", "").strip(), maxsplit=1)[0])
    names = _LAYOUT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").split()
    parts, whole = set(), set()
    if tag not in ("html", "body", "main"):
        for name in names:
            words = [w for w in _PARTS.split(name) if w]
            hits = {w for w in words if _marks(w)}
            parts |= hits
            if hits and all(w in hits or w in _NEUTRAL for w in words):
                whole |= hits
    main = tag in ("article", "main") or role in ("main", "article")
    hidden = "hidden" in found or "hidden" in names or re.search(r"display\s*+:\s*+none", found.get("style", "")) is not None
    marked = tag in _CHROME_TAGS or role in _CHROME_ROLES or hidden
    whole -= _TITLE_NAMES
    kind = f"{label}.{first}" if first else label
    if main:
        return kind, marked, marked or bool(whole), 1 if whole else 2
    return kind, marked or tag == "header" or bool(parts), marked or bool(whole), 0


@lru_cache(maxsize=4096)
def _judged_once(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    return _judged(tag, attrs)


def _repaired(text: str, at: int) -> tuple[str, str, str, int] | None:
    """The tag at `at`, read attribute by attribute: (slash, name, attributes, end); None if it never ends."""
    m = _OPEN.match(text, at)
    begin = here = m.end()
    while True:
        m2 = _ATTR.match(text, here)
        if m2 is None:
            break
        here = m2.end()
        if m2[2] is None and _QUOTE.match(text, here):
            return None
    while here < len(text) and text[here] != ">":  # white space or slashes
        here += 1
    return (m[1], m[2], text[begin:here], here + 1) if here < len(text) else None


#: Elements that a start tag ends, as groups of tags: the nearest open one of the group, within the nearest of _HOLD.
_GROUPS = ("p", "li", "dtdd", "tr", "tdth", "option")
_IN_GROUP = {"p": (0,), "li": (1,), "dt": (2,), "dd": (2,), "tr": (3,), "td": (3, 4), "th": (3, 4), "option": (5,)}
_ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5} | dict.fromkeys(_ENDS_P, 0)
_NONE = (-1,) * len(_GROUPS)


class Page:
    """shape: the reduced tree as text; blocks: (node number in the order of shape, text, whether not chrome, main part as in _facts)."""

    __slots__ = ("blocks", "shape")

    def __init__(self, text: str):
        kinds, children, nodes = ["#"], [[]], [0]  # of reduced nodes; nodes: the reduced node of each open element
        stack: list[tuple[str, bool, int, tuple[int, ...]]] = [("#", False, 0, _NONE)]  # tag, chrome, main part, nearest open of each group
        opened: dict[str, list[int]] = {}  # where each tag is open
        out: list[tuple[int, str, bool, int]] = []
        piece: list[str] = []
        mute, mute_tag, mute_in = 0, "", 0  # how many of mute_tag are open since an inline element that is chrome, and the size of the stack there
        at, size = 0, len(text)

        def flush() -> None:
            if piece:
                raw = "".join(piece)
                piece.clear()
                raw = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
                if raw:
                    out.append((nodes[-1], raw, not stack[-1][1], stack[-1][2]))

        def close(k: int) -> None:
            nonlocal mute
            flush()
            for entry in stack[k:]:
                opened[entry[0]].pop()
            del stack[k:], nodes[k:]
            if len(stack) < mute_in:
                mute = 0

        while at < size:
            lt = text.find("<", at)
            if lt < 0:
                if not mute:
                    piece.append(text[at:])
                break
            if lt > at and not mute:
                piece.append(text[at:lt])
            m = _TAG.match(text, lt)
            if m is not None:
                slash, tag, attrs = m[1], m[2], m[3]
                at = m.end()
            else:
                after = text[lt + 1 : lt + 9]
                if after.startswith("!--"):
                    end = _COMMENT_END.search(text, lt + 2 if text.startswith(("<!-->", "<!--->"), lt) else lt + 4)
                    at = end.end() if end else size
                    continue
                if after == "![CDATA[":
                    end = text.find("]]>", lt)
                    if not mute:
                        piece.append(text[lt + 9 : end if end >= 0 else size])
                    at = end + 3 if end >= 0 else size
                    continue
                if after[:1] in ("!", "?") or (after[:1] == "/" and not (after[1:2].isascii() and after[1:2].isalpha())):
                    end = text.find(">", lt) if len(after) > 1 or after != "/" else -1
                    at = end + 1 if end >= 0 else size
                    continue
                if _OPEN.match(text, lt) is None:
                    if not mute:
                        piece.append("<")
                    at = lt + 1
                    continue
                got = _repaired(text, lt)
                if got is None:
                    break
                slash, tag, attrs, at = got
            tag = tag.lower()
            if slash:
                if tag in _INLINE:
                    mute -= mute > 0 and tag == mute_tag
                    continue
                where = opened.get(tag)
                if where:
                    close(where[-1])
                elif tag == "p" or tag in _ENDS_P:
                    flush()
                continue
            if tag in _RAW:
                if not (tag in ("svg", "math") and attrs.endswith("/")):
                    end = _ends_of(tag).search(text, at)
                    close_at = text.find(">", end.start()) if end else -1
                    at = close_at + 1 if close_at >= 0 else size
                continue
            if tag in _VOID:
                if tag == "br":
                    piece.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in _INLINE:
                if mute:
                    mute += tag == mute_tag
                elif attrs and _facts(tag, attrs)[2]:
                    mute, mute_tag, mute_in = 1, tag, len(stack)
                continue
            kind, outside, within, main = _facts(tag, attrs)
            flush()
            group = _ENDS.get(tag)
            if group is not None and stack[-1][3][group] > 0:
                close(stack[-1][3][group])
            up = nodes[-1]
            if children[up] and kinds[children[up][-1]] == kind:
                node = children[up][-1]
            else:
                node = len(kinds)
                kinds.append(kind)
                children.append([])
                children[up].append(node)
            _, chrome, inside, near = stack[-1]
            marked = within if inside else outside
            if tag in _HOLD:
                near = _NONE
            elif tag in _IN_GROUP:
                near = tuple(len(stack) if g in _IN_GROUP[tag] else k for g, k in enumerate(near))
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, chrome or marked or mute > 0, inside or (0 if marked else main), near))
            nodes.append(node)
        flush()
        order: dict[int, int] = {}

        parts: list[str] = []
        todo: list = [0]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
                continue
            order[node] = len(order)
            parts.append(kinds[node])
            inner = children[node]
            if inner:
                todo.append(")")
                for k in range(len(inner) - 1, -1, -1):
                    todo += [inner[k], "," if k else "("]

        self.shape = "".join(parts)
        self.blocks = [(order[n], t, c, m) for n, t, c, m in out]

    def content(self, constant: set[int] | frozenset = frozenset(), places: dict[int, int] | None = None) -> str:
        """The text, without the blocks whose slot() at the node in `places` is in `constant`."""
        blocks = [b for b in self.blocks if b[2]]
        best = max((b[3] for b in blocks), default=0)
        blocks = [b for b in blocks if b[3] == best]
        if constant and places is not None:
            blocks = [b for b in blocks if b[0] not in places or slot(places[b[0]], mark(b[1])) not in constant] or blocks
        return "\n".join(b[1] for b in blocks)


@lru_cache(maxsize=64)
def _ends_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)


def slot(node: int, text_mark: int) -> int:
    """A node and the mark of a text as one number of 63 bits."""
    return ((text_mark * 0x9E3779B97F4A7C15) ^ ((node + 1) * 0xC2B2AE3D27D4EB4F)) & 0x7FFFFFFFFFFFFFFF


def mark(text: str) -> int:
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw) ^ len(raw)


def read_shape(shape: str) -> tuple[list[str], list[list[int]]]:
    """Kind and children of each node, numbered in pre-order."""
    kinds, children, stack = [], [], []
    for before, kind, ends in _NODE.findall(shape):
        if before == "(":
            stack.append(len(kinds) - 1)
        if stack:
            children[stack[-1]].append(len(kinds))
        kinds.append(kind)
        children.append([])
        if ends:
            del stack[-len(ends) :]
    return kinds, children


class Subtrees:
    """Subtrees of two trees by content: equal ones share a number, so each pair of contents is matched once."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.facts: list[tuple[str, tuple[int, ...], int]] = []  # kind, children, size
        self.sizes: dict[tuple[int, int], int] = {}

    def number(self, kinds: list[str], children: list[list[int]]) -> list[int]:
        out = [0] * len(kinds)
        for n in range(len(kinds) - 1, -1, -1):
            key = (kinds[n], tuple([out[c] for c in children[n]]))
            if key not in self.known:
                self.known[key] = len(self.facts)
                self.facts.append((*key, 1 + sum(self.facts[c][2] for c in key[1])))
            out[n] = self.known[key]
        return out

    def size(self, a: int, b: int) -> int | None:
        """The size of the largest order-keeping match of two trees with equal roots; None where it isn't known yet."""
        x, y = self.facts[a], self.facts[b]
        if x[0] != y[0]:
            return 0
        if a == b:
            return x[2]
        return self.sizes.get((a, b)) if x[1] and y[1] else 1

    def _same(self, a: int, b: int) -> tuple[tuple, tuple, int]:
        """Children of both, and how many equal ones they begin with; some best match has those in pairs."""
        x, y = self.facts[a][1], self.facts[b][1]
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        return x, y, k

    def _gains(self, x: tuple, y: tuple):
        """gains(c): the sizes of child c of x against all of y; made as needed, few are kept."""
        uy = {c: k for k, c in enumerate(dict.fromkeys(y))}
        at, known = np.array([uy[c] for c in y], dtype=np.int64), {}

        def gains(c: int) -> np.ndarray:
            if c not in known:
                if len(known) * len(y) > 1 << 23:
                    known.clear()
                known[c] = np.array([self.size(c, d) for d in uy], dtype=np.int32)[at]
            return known[c]

        return gains

    def match(self, a: int, b: int) -> int:
        """size(a, b), after that of all pairs below that it rests on."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if self.size(a, b) is not None:
                todo.pop()
                continue
            x, y, k = self._same(a, b)
            left, right = dict.fromkeys(x[k:]), {}
            for d in dict.fromkeys(y[k:]):
                right.setdefault(self.facts[d][0], []).append(d)
            open_ = [(c, d) for c in left for d in right.get(self.facts[c][0], ()) if self.size(c, d) is None]
            if open_:
                todo += open_
                continue
            row, gains = np.zeros(len(y) - k + 1, dtype=np.int32), self._gains(x[k:], y[k:])
            for c in x[k:]:
                row = _next_row(row, gains(c))
            self.sizes[(a, b)] = 1 + sum(self.facts[c][2] for c in x[:k]) + int(row[-1])
        return self.size(a, b)

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """The children that match(a, b) pairs, by position."""
        x, y, k = self._same(a, b)
        out = [(i, i) for i in range(k)]
        x, y = x[k:], y[k:]
        gains, row, every = self._gains(x, y), np.zeros(len(y) + 1, dtype=np.int32), int(len(x) ** 0.5) + 1
        marks = [row]  # every so many rows of the table; those between are made again on the way back
        for n, c in enumerate(x, 1):
            row = _next_row(row, gains(c))
            if n % every == 0:
                marks.append(row)
        i, j, rows, first = len(x), len(y), [], -1
        while i and j:
            if first != (i - 1) // every * every:
                first = (i - 1) // every * every
                rows = [marks[first // every]]
                for c in x[first : first + every]:
                    rows.append(_next_row(rows[-1], gains(c)))
            before, here, gain = rows[i - 1 - first], rows[i - first], gains(x[i - 1])[j - 1]
            if gain and here[j] == before[j - 1] + gain:  # of equal matches the one that pairs the ends
                i, j = i - 1, j - 1
                out.append((k + i, k + j))
            elif here[j] == before[j]:
                i -= 1
            else:
                j -= 1
        return out


def _next_row(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
    new = np.zeros_like(row)
    new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))
    return new


def _aligned(shape: str, reference: str) -> dict[int, int]:
    (xk, xc), (yk, yc) = read_shape(shape), read_shape(reference)
    trees = Subtrees()
    xs, ys = trees.number(xk, xc), trees.number(yk, yc)
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        if trees.match(xs[x], ys[y]):
            out[x] = y
            if xc[x] and yc[y]:
                todo += [(xc[x][i], yc[y][j]) for i, j in trees.pairs(xs[x], ys[y])]
    return out


@lru_cache(maxsize=20000)
def _many(shape: str, reference: str) -> dict[int, int]:
    return _aligned(shape, reference)


@lru_cache(maxsize=50)
def _few(shape: str, reference: str) -> dict[int, int]:
    return _aligned(shape, reference)


def aligned(shape: str, reference: str) -> dict[int, int]:
    """Node numbers of `shape` to those of `reference` by simple tree matching; few of large trees are kept, which bounds memory."""
    return (_many if len(shape) + len(reference) < 8000 else _few)(shape, reference)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1), F.lit("")))


def _surveyed(batches):
    for batch in batches:
        rows = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = Page(text.as_py() or "")
            marks = sorted({(n, mark(t)) for n, t, c, _ in page.blocks if c})
            rows.append((host, page.shape, [x[0] for x in marks], [x[1] for x in marks]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["host", "shape", "nodes", "marks"])


def _placed(batches):
    for batch in batches:
        hosts, slots = [], []
        for h, s, ref, ns, ms in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "reference", "nodes", "marks"))):
            places = aligned(s, ref)
            for x in {slot(places[n], m) for n, m in zip(ns, ms) if n in places}:
                hosts.append(h)
                slots.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, pa.int64())], names=["host", "slot"])


def wrappers(pages: DataFrame) -> DataFrame:
    """From (host, html): (host, reference, constant): the reference shape and the slots of template blocks, for hosts that have any."""
    seen = store.stash(pages.select("host", "html").mapInArrow(_surveyed, "host string, shape string, nodes array<int>, marks array<long>"), "shapes")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("n"))
    refs = shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("reference"), F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    refs = store.stash(refs, "references")
    placed = seen.join(refs.select("host", "reference"), "host").mapInArrow(_placed, "host string, slot long")
    often = placed.groupBy("host", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    often = often.join(refs, "host").where(F.col("n") >= CONSTANT * F.col("pages"))
    out = store.stash(often.groupBy("host").agg(F.first("reference").alias("reference"), F.collect_list("slot").alias("constant")), "wrappers")
    store.discard(seen, refs)
    return out


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text and n_chars added and html gone (more underscores where pages has such columns)."""
    known = wrappers(pages.select(host_of(url).alias("host"), F.col(html).alias("html")))
    host, ref, constant, text, n = (store.free_name(c, pages.columns) for c in ("_host", "_reference", "_constant", "text", "n_chars"))
    keyed = pages.withColumn(host, host_of(url))
    joined = keyed.join(known.select(F.col("host").alias(host), F.col("reference").alias(ref), F.col("constant").alias(constant)), host, "left")
    keep = [c for c in pages.columns if c != html]

    def run(batches):
        known_: dict[str, tuple[str, set[int]] | None] = {}  # of this task
        for batch in batches:
            out = []
            for k, (h, raw) in enumerate(zip(batch.column(host).to_pylist(), batch.column(html))):
                page = Page(raw.as_py() or "")
                if h not in known_:
                    if len(known_) > 5000:
                        known_.clear()
                    r = batch.column(ref)[k].as_py()
                    known_[h] = None if r is None else (r, set(batch.column(constant)[k].as_py()))
                of = known_[h]
                out.append(page.content() if of is None else page.content(of[1], aligned(page.shape, of[0])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*keep, text, n])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html] + [f"`{text}` string, `{n}` long"])
    return joined.mapInArrow(run, schema)


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
