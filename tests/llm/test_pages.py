"""Whole texts of pages against a plain reading of their markup, names that mark and don't, hostile markup, large pages of a host."""

import html.parser
import random
import time
from collections import Counter

import pytest

from prismlane.llm import webtext
from prismlane.llm.webtext import Page

from ..conftest import MEDIUM

BLOCKS = {"html", "body", "nav", "ul", "li", "div", "article", "main", "section", "h1", "h2", "p", "footer", "aside", "form", "header", "blockquote", "pre", "table", "tr", "td"}


class Plain(html.parser.HTMLParser):
    """Blocks of a well-formed page by the standard library's parser: (path, text, in the article, in something marked)."""

    def __init__(self, marked):
        super().__init__(convert_charrefs=True)
        self.marked, self.path, self.blocks, self.text, self.skip = marked, [], [], [], 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            tags = [t for t, _ in self.path]
            self.blocks.append((tuple(tags), text, "article" in tags, any(m for _, m in self.path)))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if tag in ("p", "ul", "div", "h1", "h2") and self.path and self.path[-1][0] == "p":
                self.path.pop()
            if tag == "li" and self.path[-1][0] == "li":
                self.path.pop()
            self.path.append((tag, self.marked(tag, dict(attrs))))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        elif tag in BLOCKS:
            self.flush()
            if tag in [t for t, _ in self.path]:
                while self.path.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def plain(text, marked):
    p = Plain(marked)
    p.feed(text or "")
    p.close()
    p.flush()
    blocks = [b for b in p.blocks if not b[3]]
    return [b for b in blocks if b[2]] or blocks


def host(url):
    return url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower()


def test_whole_texts_of_the_pages(spark):
    """Every block of every page, in order, template blocks of a host gone."""
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()
    marked = lambda tag, a: tag in ("nav", "footer", "aside", "form") or "ad" in (a.get("class") or "").split()
    blocks = {r["page_id"]: plain(r["html"], marked) for r in pages}
    size, often = Counter(host(r["url"]) for r in pages), Counter()
    for r in pages:
        often.update({(host(r["url"]), b[1]) for b in blocks[r["page_id"]]})
    got = {r["page_id"]: r for r in webtext.op2_wrapper_text(spark, MEDIUM).collect()}
    assert len(got) == len(pages)
    for r in pages:
        mine = [b[1] for b in blocks[r["page_id"]]]
        h = host(r["url"])
        left = [t for t in mine if not (often[h, t] >= webtext.MIN_PAGES and often[h, t] >= webtext.CONSTANT * size[h])]
        assert got[r["page_id"]]["text"] == "\n".join(left or mine) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_whole_texts_of_a_made_site(spark):
    """Pages with every kind of chrome, template blocks without a mark, inline markup and references."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(30):
        parts, body = [], []
        for _ in range(rng.randrange(1, 40)):
            t = prose(rng.randrange(1, 30))
            kind = rng.randrange(5)
            if kind == 0:
                parts.append(f"<p>{t} <b>bold &amp; more</b></p>")
                t += " bold & more"
            elif kind == 1:
                parts.append(f"<ul class=facts><li>{t}\n\n<li>second  item {i}</ul>")
                t += f"\nsecond item {i}"
            elif kind == 2:
                parts.append(f"<div class='ad-slot'>Buy {prose(4)}</div><p>{t}<span class=sponsored>now {prose(2)}</span>")
            elif kind == 3:
                parts.append(f"<blockquote>{t}<a class='share-button' href='x?a>b'>Share</a></blockquote>")
            else:
                parts.append(f"<table><tr><td>{t}<td>cell {i}</table>")
                t += f"\ncell {i}"
            body.append(t)
        page = f"""<!DOCTYPE html><html><head><title>T {i}</title></head><body class="search-page"><header>Site</header><nav>Home</nav><div id=side-bar class="sidebar">{prose(9)}</div>
<article class="news-notice"><h1>Head {i}</h1><p>Written by our desk</p>{"".join(parts)}<p>Send us your view</p></article>
<section class="comments"><article class="comment">Nice {prose(3)}</article></section><article class="comment-body">me too {prose(3)}</article><footer>{prose(3)}</footer></body></html>"""
        rows.append((i, "https://made.example/a", page))
        want[i] = "\n".join([f"Head {i}", *body])
    got = {r["page_id"]: r["text"] for r in webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<article class="news-notice"><p>Body</article>', "Body"),
        ('<main><section class="search-history"><p>x</p></section></main>', "x"),
        ('<article><p>A <span class="ad">AD</span>B <a class="share-button">Share</a>c</p><p>d <span class=promo>open</p><p>e</p></article>', "A B c\nd\ne"),
        ('<article><a class="promo"><div>in</div></a><p>out</p></article>', "out"),
        ('<article><p>x <span class=ad>a <span>b</span> c</span> y</p></article>', "x y"),
        ('<article class="comment"><p>only</p></article>', "only"),
        ('<article><p>story</p></article><article class="comment"><p>reader</p></article>', "story"),
        ('<article><p>story</p><article class="reply"><p>reader</p></article></article>', "story"),
        ("<foo(bar>x</foo(bar><foo,)bar>y", "x\ny"),
        ("<p title='a>b'>x</p><p title=\"c>d\">y</p>", "x\ny"),
        ("<p =a>x</p><p a= >y</p><p a b/=c>z</p>", "x\ny\nz"),
        ('<p>x</p><p a="never closed>y</p>', "x"),
        ("<p>x<!-->y<!--->z<!-- a --!>u", "xyzu"),
        ("<p>1 < 2 <3 </ >x", "1 < 2 <3 x"),
        ("a<![CDATA[<b>]]>c", "a<b>c"),
        ("<p>x<svg/>y<svg><text>no</text></svg>z", "xyz"),
        ("<p>a<script>if (1<2) '</p>'</script >b", "ab"),
    ],
)
def test_names_and_broken_tags(text, want):
    page = Page(text)
    assert page.content() == want
    kinds, children = webtext.read_shape(page.shape)
    assert len(kinds) == 1 + sum(map(len, children)) and all(b[0] < len(kinds) for b in page.blocks)


@pytest.mark.parametrize("unit", ['<p "', '<p a="x', "<a a", "<p =", "<", "</", "<p a = ", "&", "<span class=ad>", "<script>", "<!-- ", "<!a", "<![CDATA[", "<foo(bar>,)x", '<p class="a (', "<div style='a:b", "</b2><center>"])
def test_a_megabyte_of_broken_markup(unit):
    began = time.perf_counter()
    page = Page(unit * (1_000_000 // len(unit)))
    page.content()
    webtext.read_shape(page.shape)
    assert time.perf_counter() - began < 20


def test_deep_and_unclosed():
    for text in ("<center>" * 50000 + "</b2>" * 50000, "<center>" * 50000 + "<h1></h1>" * 20000, "<p><body>" + "<center>" * 50000 + "<h1></h1>" * 20000, "<div " + "a" * 1_000_000 + ">x"):
        began = time.perf_counter()
        Page(text).content()
        assert time.perf_counter() - began < 20


@pytest.mark.parametrize("n", [100, 199, 201, 2500])
def test_template_of_a_host_whatever_its_size(spark, n):
    """200 to 5000 nodes a page; the unmarked template goes at every size."""
    made = lambda i: "".join(f"<h2>Head {i} {k}</h2><p>Text {i} {k}</p>" for k in range(n + i))
    rows = [(i, "http://h.example/", f"<body><div>Our weekly offer</div>{made(i)}<section><p>Write to us</p></section></body>") for i in range(4)]
    rows += [(10 + i, "http://odd.example/", f"<body><foo(bar><p>Template, (of all)</p></foo(bar>{made(i)}</body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == got[10 + i] == "\n".join(x for k in range(n + i) for x in (f"Head {i} {k}", f"Text {i} {k}"))
