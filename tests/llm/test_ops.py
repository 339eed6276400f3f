"""The ten operators on rows with nulls, empty and long texts, ties, repeats and clashing columns, against plain models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prismlane.llm import langid, linededup, mixing, neardup, quality, queries, repetition, store, toxicity, urlfilter, webtext

from ..conftest import MEDIUM, SMALL, same_rows
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


# 1 mixing


def check_mix(got, rows):
    sizes, by = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    want = brute.mix_targets(sizes)
    assert sorted(((g["doc_id"], g["size"]) for g in got), key=repr) == sorted(((r[0], len(brute.words(r[1]))) for r in rows), key=repr)
    for g in got:
        assert g["source_size"] == sizes[g["source"]] and g["target"] == pytest.approx(want[g["source"]]) and 0 <= g["taken"] <= 2 * g["size"]
        by[g["source"]] = by.get(g["source"], 0) + g["taken"]
    for s, n in by.items():
        assert abs(n - want[s]) <= 0.5 + 1e-9


def test_mix(docs, rows, empty):
    got = mixing.usage(docs).collect()
    check_mix(got, rows)
    assert sorted(map(repr, mixing.usage(docs).collect())) == sorted(map(repr, got))
    assert mixing.usage(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.usage(docs.where("text is null")).first()["taken"] == 0


def test_mix_medium(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    check_mix(mixing.usage(docs).collect(), [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])


def test_mixed_text_is_whole_blocks(docs, rows):
    out = mixing.mixed(docs, block=16).collect()
    used = mixing.usage(docs, block=16).where("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()
    per = {}
    for r in out:
        assert len(brute.words(r["text"])) == r["n_words"] > 0
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["n_words"]
    assert per == {r["doc_id"]: r["n"] for r in used}
    slots = {}
    for r in out:
        slots.setdefault(r["slot"], []).append(r)
    assert max(sum(x["n_words"] for x in s) for s in slots.values()) <= 16
    for s in slots.values():  # pieces of a slot follow each other and are of one source
        s.sort(key=lambda x: x["first"])
        assert s[0]["first"] == 0 and all(a["first"] + a["n_words"] == b["first"] for a, b in zip(s, s[1:])) and len({x["source"] for x in s}) == 1
    text = {r[0]: brute.words(r[1]) for r in rows}
    assert all(brute.words(r["text"]) == text[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]] for r in out)


def test_mixed_text_is_the_source_text(spark, docs, rows):
    """A document's pieces of a whole pass, in order, are its text with its line breaks and spaces."""
    more = spark.createDataFrame([(20, "  lead\n\n two\tthree  \r\n" + "four  five\n" * 40 + " end \n ", "zz"), (None, "a  b", "zz"), (None, "a  b", "zz"), (20, "other\ttext", "zz")], "doc_id long, text string, source string")
    wide = docs.select("doc_id", "text", "source").unionByName(more).withColumn("mark", F.lit(1)).withColumn("copies", F.lit("x"))
    texts = [(r["doc_id"], r["source"], r["text"]) for r in wide.collect()]
    words = {t: brute.words(t) for _, _, t in texts}
    out = mixing.mixed(wide, block=16).collect()
    by = {}
    for r in out:
        mine = [t for d, s, t in texts if (d, s) == (r["doc_id"], r["source"]) and r["text"] in (t or "")]
        assert mine and brute.words(r["text"]) == words[mine[0]][r["first_word"] : r["first_word"] + r["n_words"]]
        by.setdefault((r["doc_id"], r["source"]), {})[r["first_word"]] = r["text"]
    assert "".join(v for _, v in sorted(by[5, "a"].items())) == brute_text(rows, 5)
    whole = [k for k, v in by.items() if "".join(x for _, x in sorted(v.items())) in [t for d, s, t in texts if (d, s) == k]]
    assert len(whole) >= len(by) / 2


def brute_text(rows, doc_id):
    return next(r[1] for r in rows if r[0] == doc_id)


def test_mix_of_copies_and_null_ids(spark, monkeypatch):
    """Thousands of equal rows are one row with a count, dealt to tasks; null ids are documents of their own."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    made = [(7, "one two three four", None, "a")] * 700 + [(None, f"null id {i}", None, "a") for i in range(300)] + [(k, "x y " * (k % 50), None, "bc"[k % 2]) for k in range(200)] + [(None, None, None, "a")] * 40
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    sized = mixing.measured(df)
    assert sized.count() == 700 - 699 + 300 + 200 + 1
    check_mix(mixing.usage(df, block=8).collect(), made)
    out = mixing.mixed(df, block=8)
    assert out.agg(F.sum("n_words")).first()[0] == mixing.usage(df, block=8).agg(F.sum("taken")).first()[0]


def test_ranges_follow_the_rows(spark, docs, monkeypatch):
    """Offsets are the same however finely a source is split."""
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 1)
    src = mixing.sources(sized := mixing.measured(docs))
    got = sorted((r["sid"], r["at"], r["size"], r["copies"]) for r in mixing.packed(sized, src).collect())
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 1 << 30)
    assert got == sorted((r["sid"], r["at"], r["size"], r["copies"]) for r in mixing.packed(sized, src).collect())
    for sid in {g[0] for g in got}:  # texts follow each other without a gap
        end = 0
        for _, at, size, copies in (g for g in got if g[0] == sid):
            assert at == end
            end += size * copies


def test_shards_are_multinomial_draws(spark):
    """Counts of a shard sum to its slots, differ from shard to shard, and are near the shares; every draw has one slot."""
    docs = spark.createDataFrame([(k, "w " * 400, "abc"[min(2, k % 7 // 2)]) for k in range(700)], "doc_id long, text string, source string")
    counts = {}
    for r in mixing.shard_counts(docs, block=8, shard_slots=256).collect():
        counts.setdefault(r["shard"], {})[r["source"]] = r["n"]
    assert all(sum(c.values()) == 256 for s, c in counts.items() if s < len(counts) - 1)
    used = mixing.draws(mixing.sources(mixing.measured(docs), block=8), 8, 256).collect()
    total = len(used)
    assert sorted(u["slot"] for u in used) == list(range(total)) and len({(u["sid"], u["block"]) for u in used}) <= total
    share = {s: sum(c.get(s, 0) for c in counts.values()) / total for s in "abc"}
    wide = [c.get(s, 0) - 256 * share[s] for c in counts.values() if sum(c.values()) == 256 for s in "abc"]
    assert len(set(wide)) > 20 and all(abs(x) < 6 * (256 * 0.25) ** 0.5 for x in wide)
    assert 0.6 < sum(x * x for x in wide) / sum(len(counts) * 256 * v * (1 - v) for v in share.values()) < 1.5


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_shuffle_is_a_permutation(spark, n):
    df = mixing.with_keys(spark.range(n).select("id", F.lit(3).alias("sid"), F.lit(n).cast("long").alias("n")))
    for e in range(3):
        there = mixing.shuffled(df.withColumn("e", F.lit(e).cast("long")), "id", "e", "p").select("id", "e", "p", "sid", "n").checkpoint()
        rows = mixing.shuffled(mixing.with_keys(there), "p", "e", "back", inverse=True).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_shuffle_of_many_blocks(spark):
    """Places of 2^37 blocks are spread over all of them, not about their own place or its mirror."""
    n = 1 << 37
    df = spark.range(20000).select((F.col("id") * (n // 20000)).alias("id"), F.lit(0).alias("sid"), F.lit(n).alias("n"), F.lit(0).cast("long").alias("e"))
    p = [(r["id"], r["p"]) for r in mixing.shuffled(mixing.with_keys(df), "id", "e", "p").select("id", "p").collect()]
    far = sorted(min(abs(a - b), abs(n - a - b)) / n for a, b in p)
    assert len({b for _, b in p}) == len(p) and 0.12 < far[len(far) // 2] < 0.17 and far[-1] > 0.4


# 2 web text

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><b>no</b>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><form><input>Search</form><!-- <p>gone</p> -->
<article><h1>Title &amp; more</h1><p>First   para<br>with <b>bold</b>
 and &eacute;&#233;&nbsp;x</p><p>Second<p>Third &lt;tag&gt;<div class="ad">Buy</div><ul><li>one<li>two</ul></article><div class="comments"><p>Nice!</p></div><footer>&copy; me</footer></body></html>"""


def test_page_text():
    want = "Title & more\nFirst para with bold and éé x\nSecond\nThird <tag>\none\ntwo"
    assert webtext.Page(PAGE).content() == want
    assert webtext.Page("<div class='has-sidebar'><header class=top>Site</header><article><header class='post-header'><h1>T</h1></header><p>x</p><footer>f</footer></article></div>").content() == "T\nx"
    assert webtext.Page("<div id=page><div class=header>Site</div><div class='text'>words<div class=byline>By A</div></div><div class='ad-box'>Buy</div></div>").content() == "words\nBy A"
    marks = ["class=commentlist", "id='topNav'", "class='x sidebar-left'", "role=banner", "class='AdSlot'", "id=cookieBar", "class='newsletter_box'", "hidden", "style='display: none'"]
    for m in marks:
        assert webtext.Page(f"<body><div {m}><p>out</p></div><div class='story body-text'><p>in</p></div></body>").content() == "in", m
    for m in ("class=address", "class='adventure'", "id=radio", "class=navy", "class='no-comments'"):
        assert webtext.Page(f"<body><div {m}><p>in</p></div></body>").content() == "in", m
    for cut in range(0, len(PAGE), 7):  # broken markup never fails
        webtext.Page(PAGE[:cut]).content()
    assert webtext.Page("").content() == "" and webtext.Page("just <i>text</i> here").content() == "just text here"
    assert webtext.Page("<p>" * 3000 + "deep").content() == "deep" and webtext.Page("<div><span>" * 3000 + "deep").content() == "deep"
    assert webtext.Page("<a><b><section>x</section>" * 500).shape


def test_wrapper_drops_constant_blocks(spark):
    def page(i, extra=""):
        return f"<html><body>{extra}<article><p>Text number {i} is here</p><p>Read our other stories</p></article></body></html>"

    rows = [(i, f"http://Host.example/{i}", page(i, "<div><p>x</p></div>" if i % 2 else ""), "t") for i in range(6)]
    rows += [(10 + i, "http://copies.example/", page(0), "t") for i in range(4)]
    rows += [(20, "http://one.example/", page(20), "t"), (21, None, None, None), (22, "no url", "", None), (23, None, page(23), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in webtext.main_text(df).collect()}
    assert [got[i]["text_"] for i in range(6)] == [f"Text number {i} is here" for i in range(6)]
    assert got[10]["text_"].count("\n") == 1 and got[20]["text_"].count("\n") == 1  # copies and lone pages keep all
    assert got[21]["text_"] == got[22]["text_"] == "" and got[21]["n_chars"] == 0 and got[0]["text"] == "t"
    assert webtext.main_text(df.limit(0)).count() == 0


def test_alignment():
    a, b = "#(html(body(nav(li),article(p),footer)))", "#(html(body(div(p),article(h1,p),footer)))"
    m = webtext.aligned(a, b)
    assert m[0] == 0 and m[5] == 5 and m[6] == 7 and m[7] == 8 and 3 not in m
    assert webtext.aligned(a, a) == {i: i for i in range(8)}


def tree_match(a, b):
    """Simple tree matching of (kind, children) by plain recursion."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + tree_match(x, y))
    return best[-1][-1] + 1


def test_alignment_is_a_largest_match():
    rng = random.Random(5)

    def tree(depth):
        return rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []

    def text(t):
        return t[0] + (f"({','.join(map(text, t[1]))})" if t[1] else "")

    for _ in range(100):
        x, y = ("#", [tree(3) for _ in range(3)]), ("#", [tree(3) for _ in range(3)])
        a, b = text(x), text(y)
        m = webtext.aligned(a, b)
        kinds = [webtext.read_shape(t)[0] for t in (a, b)]
        assert len(m) == tree_match(x, y) and all(kinds[0][i] == kinds[1][j] for i, j in m.items())
        assert [m[i] for i in sorted(m)] == sorted(m.values())


def test_wrapper_of_large_and_deep_pages(spark):
    """Template blocks go from pages of any size; several children of the root keep their numbers."""
    parts = lambda i, n: "".join(f"<h2>Head {i} {k}</h2><p>Text {i} {k}</p>" for k in range(n))
    large = lambda i: f"<div>lead {i}</div><section><p>Read our other stories</p></section>{parts(i, 300 + i)}<section><p>Write to the editor</p></section>"
    deep = lambda i: "<div>" * 3000 + f"<h2>Own {i}</h2><p>Read our other stories</p>" + "</div>" * 3000
    rows = [(i, "http://large.example/", large(i)) for i in range(5)] + [(10 + i, "http://deep.example/", deep(i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].split("\n") == [f"lead {i}"] + [x for k in range(300 + i) for x in (f"Head {i} {k}", f"Text {i} {k}")]
        assert got[10 + i] == f"Own {i}"


def test_pages_give_their_article(spark):
    got = webtext.op2_wrapper_text(spark, MEDIUM).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(got) == len(html)
    for r in got:
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        assert r["n_chars"] == len(r["text"]) > 0 and r["text"].split("\n")[0] in __import__("html").unescape(inner)


# 3 lines


def test_lines(spark, docs, rows, empty):
    many = [(i, f"own {i} text that is longer than the furniture\n Subscribe now \nmore of {i} here", "s") for i in range(5)] + [(9, "copy", "s"), (9, "copy", "s"), (8, None, "s"), (7, "", None), (6, "Subscribe now", None)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(df).collect()}
    assert got[(0, "own 0 text that is longer than the furniture\nmore of 0 here")] == (3, 1)
    assert got[(9, "copy")] == (1, 0) and got[(8, None)] == (0, 0) and got[(7, "")] == (0, 0) and got[(6, "Subscribe now")] == (1, 0)
    assert linededup.line_dedup(empty).count() == 0 and linededup.line_dedup(docs).count() == len(rows)
    clash = df.withColumn("n_lines", F.lit("mine")).withColumn("_host", F.lit(1))
    out = linededup.line_dedup(clash)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "_host", "n_lines_", "n_dropped"] and out.first()["n_lines"] == "mine"


def test_lines_of_pages_of_furniture(spark):
    menu = ["Subscribe to our weekly letter", "All rights reserved by the publisher", "Follow us on every network"]
    made = [(i, "\n".join([f"Story {i} of its own", *menu]), "s") for i in range(5)] + [(8, "\n".join([*menu, "ok"]), "s"), (9, "\n".join(menu), "s")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert got[0] == ("Story 0 of its own", 4, 3) and got[8] == ("ok", 4, 3) and got[9] == ("", 3, 3)


# 4 to 6 classifiers


def test_language(spark, docs, rows, empty):
    out = langid.op4_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (brute.bucket(r["doc_id"], 4) == 2) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in out)
    learned = langid.profiles(docs)
    got = langid.identify(docs.withColumn("score", F.lit(9)), learned).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == "und" and r["score_"] == 0.0 for r in got if not any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(empty, learned).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.profiles(empty) == {}


def test_rank_order_distance():
    assert langid.ranked(langid.grams("aa b"), 2).tolist() == sorted(langid.ranked(langid.grams("aa b"), 2).tolist(), key=lambda c: (-langid.grams("aa b").tolist().count(c), c))
    assert len(langid.grams("123 !!")) == 0 and len(langid.grams(None)) == 0


def test_quality(spark, docs, empty):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    out = quality.op5_quality_rules(spark, MEDIUM).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    again = {r["doc_id"]: r["score"] for r in quality.op5_quality_rules(spark, MEDIUM).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in out)
    got = quality.scored(docs, labels.limit(0))
    assert {r["score"] for r in got.collect()} == {0.5}
    lab = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, lab)
    assert got.count() == docs.count() and quality.scored(empty, lab).count() == 0
    kept = quality.quality_filter(docs.withColumn("f_words", F.lit("mine")), lab, cut=0.0)
    assert kept.columns == [*docs.columns, "f_words"] and kept.count() == docs.count()


def test_toxicity(spark, docs, empty, rows):
    out = toxicity.op6_toxicity(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (brute.bucket(r["doc_id"], 3) == 1) for r in out)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs.withColumn("toxicity", F.lit("x")), docs, none).collect()
    assert len(got) == len(rows) and {r["toxicity_"] for r in got} == {0.0}
    assert toxicity.score(empty, docs, none).count() == 0


def kinds_of(text):
    """What the grammar finds in a text, by kind, with scum and idiot as the insults."""
    lex = toxicity.Lexicon({"scum": 5.0, "idiot": 3.0, "fool": 2.0}, {"loweix"[:5]: 4.0})
    return {k: v for k, v in zip(toxicity.KINDS, lex.evidence(text)) if v}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He is scum.", {"A": 5}), ("scum he is", {"A": 5}), ("utter scum here", {"I": 5}), ("never a scum here", {"i": 5}), ("not in all of this long talk scum", {"I": 5}),
        ("said scum. fine", {"r": 5}), ("not. scum", {"I": 5}), ("you loweiabc", {"A": 4}), ("scummy alowei fine words", {}), (None, {}), ("", {}),
        ("I will kill you", {"B": 1}), ("you i will kill", {"B": 1}), ("He killed them", {"B": 1}), ("this kills you", {"B": 1}), ("kill it", {"H": 1}), ("ich werde dich töten", {"B": 1}), ("I won't kill you", {"h": 1}),
        ("He said: you are an idiot", {"r": 3}), ("You are an idiot, he said", {"r": 3}), ("You are an idiot who said nonsense", {"A": 3}), ('"You are an idiot!" he said.', {"r": 3}),
        ('She wrote: "You are an idiot. You are scum." Fine.', {"r": 5}), ('She wrote: "Fine." You are scum', {"A": 5}), ("She said you will kill him", {"q": 1}),
        ("not, in any way at all, an idiot", {"i": 3}), ("I don't care, you idiot", {"A": 3}), ("not nice but scum", {"I": 5}), ("You are not an idiot, he said", {"i": 3}), ("you\nscum", {"I": 5}),
        ("fool and idiot; scum", {"I": 5}), ("a fool and an idiot", {"I": 5}), ("IDIOT! you", {"I": 3}),
    ],
)
def test_grammar(text, want):
    assert kinds_of(text) == want


def parsed(symbols):
    """The grammar of one line as plain loops over its symbols, the composed machines' rule by rule."""
    out = []
    for p, s in enumerate(symbols):
        if s not in "IH":
            out.append(s)
            continue
        before, after = symbols[:p], symbols[p + 1 :]
        clause = "".join(before).rsplit("C", 1)[-1]
        rest = "".join(after).split("C", 1)[0]
        # negation: the last one of the clause, after the last adversative
        scope = clause.rsplit("X", 1)[-1]
        negated = False
        if "N" in scope:
            between = [x for x in scope.rsplit("N", 1)[1] if x not in "QD"]
            if between[:1] == ["K"]:
                between = between[between.index("K", 1) + 1 :] if "K" in between[1:] else ["K"]
            negated = "K" not in between and len(between) < toxicity.REACH
        # reports before: to the clause's end, or within the quote opened in that clause
        state = 0
        for x in before:
            state = max(1, state) if x == "R" else {1: 2}.get(state, 0) if x == "Q" else (0 if state == 1 else state) if x == "C" else state
        reported = state > 0
        # reports after
        state, left = "", 0
        for x in reversed(after):
            if x == "C":
                state = state if state == "quoted" else ""
            elif x == "R":
                state, left = (state, 0) if state in ("quoted", "before") else ("near", toxicity.REPORT_REACH)
            elif x == "Q":
                state = {"near": "quoted", "before": "before"}.get(state, "")
            elif state == "near" and x in "KD":
                state = "before" if x == "K" else ""
            elif state == "near":
                left -= 1
                state = state if left else ""
        reported = reported or state in ("quoted", "before")
        aimed = "T" in clause or "T" in rest
        out.append({"I": "irAI", "H": "hqBH"}[s][0 if negated else 1 if reported else 2 if aimed else 3])
    return out


def test_machines_against_plain_loops():
    lex, rng = toxicity.Lexicon({"scum": 5.0}, {}), random.Random(6)
    for _ in range(20000):
        symbols = [rng.choice("IIHTNRXOOOKQDC") for _ in range(rng.randrange(1, 14))]
        assert lex.rewritten(symbols) == parsed(symbols), symbols


def test_toxicity_against_plain_reading(spark):
    """Scores of whole texts from the learned words and weights, read word by word."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    words, stems, _ = toxicity.learn(toxicity.sampled(docs, labels))
    lex, rows, found = toxicity.Lexicon(words, stems), docs.select("doc_id", "text").collect(), {}
    for r in rows:
        best, n, top = dict.fromkeys(toxicity.KINDS, 0.0), 0, 0.0
        for line in (r["text"] or "").lower().split("\n"):
            tokens = toxicity._TOKEN.findall(line)
            read = []
            for w in tokens:
                weight = max([words.get(w.replace("’", "'"), 0.0)] + [v for k, v in stems.items() if w.replace("’", "'").startswith(k)]) if w[0].isalpha() else 0.0
                read.append(("I", weight) if weight else lex.symbol(w))
            sums = {}
            for kind, (_, weight) in zip([*parsed([s for s, _ in read]), "C"], [*read, ("C", 0)]):
                if kind in best:
                    sums[kind] = sums.get(kind, 0.0) + weight
                    top = max(top, weight)
                elif kind == "C" and sums:
                    n += 1
                    best, sums = {k: max(v, sums.get(k, 0.0)) for k, v in best.items()}, {}
        found[r["doc_id"]] = [min(v, 10.0) for v in best.values()] + [math.log1p(n), top, top * top / 10]
    for r in rows:
        assert lex.evidence(r["text"]) == pytest.approx(found[r["doc_id"]])


def test_repeated_ids_count_once(spark):
    """A label row, or a document, that is there a thousand times is one of the sample."""
    lab = spark.createDataFrame([(1, 1, 1)] * 1000 + [(2, 0, 0), (3, 1, 0), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, f"text {i % 3} of one") for i in range(1000)] + [(k, f"text {k}") for k in range(2, 7)], "doc_id long, text string")
    train = toxicity.sampled(docs, lab).collect()
    assert sorted((r["y"], r["text"]) for r in train) == sorted((y, "text 0 of one" if d == 1 else f"text {d}") for d, y in ((1, 1), (2, 0), (3, 0), (5, 1), (6, 0)) if brute.bucket(d, 3) != 1)
    got = quality.scored(docs, lab)
    assert got.count() == 1005 and got.select("score").where("doc_id = 1").distinct().count() <= 3


# 7 repetition


def test_repetition(docs, rows, empty):
    got = repetition.repetition(docs.withColumn("kept", F.lit("k"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute.repetition(r["text"])
        assert {k: r[k] for k in want} == want and r["kept"] == "k" and not (r["base_failed"] and r["kept_"])
    assert repetition.repetition(empty).count() == 0


def test_repetition_random(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "\t", "\u00a0", "d\r\n"]) for _ in range(rng.randrange(200))) for _ in range(120)]
    got = repetition.repetition(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in got:
        want = brute.repetition(r["text"])
        assert {k: r[k] for k in want} == want


def test_repetition_keeps_clean(spark):
    out = repetition.op7_repetition_coverage(spark, MEDIUM)
    assert out.where("base_failed and kept").count() == 0 and out.where("kept").count() > 700


# 8 near duplicates


def test_near_duplicates(docs, rows, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(brute.components([(r[0], r[1]) for r in rows]), key=repr)
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("compare", [512, 12])
def test_near_duplicates_chain_and_group(spark, monkeypatch, compare):
    """A chain whose ends differ, and a group of edited copies in which many pairs are just below the bound."""
    monkeypatch.setattr(neardup, "COMPARE", compare)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows, text = [], list(base)
    for k in range(25):
        rows.append((1000 - k, " ".join(text)))
        text = text[:]
        text[(k * 11) % 120] = f"c{k}"
    for k in range(150):
        w = [f"g{i}" for i in range(90)]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(90)] = f"e{rng.randrange(40)}"
        rows.append((2000 + k, " ".join(w)))
    rows += [(5000 + k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted(brute.components(rows))


def test_near_duplicates_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.op8_hyperminhash(spark, SMALL).collect())
    assert got == sorted(brute.components(rows))


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(path.where("a <> b")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == got[100] == 100
    assert neardup.components(path.limit(0)).count() == 0


# 10 urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://User@WWW.Example.NET:80/en/x?q#f", "http://example.net/en/", "http://a.example.net/en", "http://notnet/", "http://x.net?y=/", "http://b.example.com/de/1", "http://z.org/fr/", "http://z.org/FR/casino", "http://free-bet.org/", "http://spam-farm.org/a", "http://spammer.org/farming", "http://cheap.org/cheap", "http://cheap.org/a/pills?x", "http://a.org/?casino", "a://b://c/d", "http://ädult.org/adulté", "http://a.org/x#poker", "http://a.org/%63asino", "http://a.org/%zzcasino%", "http://a.org/%C3%A9casino", "casino.org/no-scheme", "HTTP://CASINO.ORG", "http://free.org/win?hot=1", "http://free.org/win", "http://pokeronline.org/", "http://free-bets.example.org", "http://long.org/" + "x" * 100000 + "/casino"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.url_filter(df).collect()}
    machine = urlfilter.automaton()
    for i, u in enumerate(urls):
        host, path, rule = brute.url(u)
        r = got[i]
        hard, soft = brute.url_terms(u, urlfilter.STRICT, urlfilter.SOFT)
        assert (hard, soft) == urlfilter.hits(machine, urlfilter.scanned(u)) == (r["strict_hits"], r["soft_weight"])
        assert (r["host_"], r["path"], r["rule"]) == (host, path, rule and rule[0]) and r["host"] == "mine"
        assert r["verdict"] == (rule[1] if rule else "block" if hard or soft >= 3 else "allow")
    verdicts = {u: got[i]["verdict"] for i, u in enumerate(urls)}
    assert all(verdicts[u] == "block" for u in ("http://spam-farm.org/a", "http://cheap.org/a/pills?x", "http://a.org/?casino", "http://a.org/x#poker", "http://a.org/%63asino", "casino.org/no-scheme", "HTTP://CASINO.ORG", "http://free.org/win?hot=1", "http://free-bets.example.org"))
    assert all(verdicts[u] == "allow" for u in ("http://spammer.org/farming", "http://cheap.org/cheap", "http://free-bet.org/", "http://free.org/win", "http://pokeronline.org/", None, ""))
    assert urlfilter.url_filter(df.limit(0)).count() == 0


def test_urls_by_own_lists(spark):
    df = spark.createDataFrame([(1, "http://a.org/red?blue"), (2, "http://b.org/red"), (3, "http://c.org/green"), (4, "http://sub.d.org/green"), (5, "http://casino.org/")], "page_id long, url string")
    got = lambda **k: {r["page_id"]: r["verdict"] for r in urlfilter.url_filter(df, **k).collect()}
    assert got(rules=[("d.org/", "allow")], strict=["green"], soft={"red": 3, "blue": 2}, reject_at=5) == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert set(got(rules=[], strict=[], soft={}).values()) == {"allow"}


def test_url_sql(spark, duck, tmp_path):
    """The SQL on addresses that the given pages don't have."""
    import duckdb

    urls = [None, "", "a%63b", "http://x.net/%63asino", "http://x.org/%63asino?%73pam=farm", "x.org/%41DS#Track", "http://x.org/%", "http://x.org/%zz-poker", "http://x.org/100%poker", "http://x.org/caf%C3%A9poker", "http://x.org/cheap+pills"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(urlfilter.op10_url_vocabulary(spark, str(tmp_path)), con.sql(urlfilter.OP10_SQL))


def test_shared_folder(spark):
    df = store.stash(spark.range(3), "t")
    assert df.count() == 3 and df._stash_path.startswith(store.shared_dir(spark))
    store.discard(df)
    assert store.free_name("A", ["a", "a_"]) == "A__"
