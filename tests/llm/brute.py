"""Plain models of the operators, written from their contracts."""

import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bucket(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def shingles(text, n=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows):
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else least.get(find(i)), (d if not sets[i] else least.get(find(i))) == d) for i, (d, _) in enumerate(rows)]


def repetition(text):
    w = words(text)
    n = len(w)
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": dup,
        "n_repeat_words": len(inside), "base_failed": n < 20 or 100 * len(inside) > 30 * n,
    }


def mix_targets(sizes):
    """Source to target, by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)[0]
        host, path = lower(m), re.match(r"[^?#]*", rest[len(m) :])[0]
    best = None
    for rule, says in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


def url_terms(u, strict, soft):
    """Strict hits and soft weight of a url, term by term."""
    raw = re.sub("(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), u or "")
    there = lambda w: re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", lower(raw)) is not None
    return sum(map(there, strict)), sum(n for w, n in soft.items() if there(w))


def count(xs):
    return Counter(xs)
