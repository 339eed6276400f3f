"""The classifiers and the pipeline against plain readings of their rules."""

import math
import re
from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pytest

from prismlane.llm import langid, leaks, linededup, quality, store, textkit

from ..conftest import SMALL
from . import brute


def n_grams(text):
    """1- to 3-grams of letters and single spaces, without an inner space, padded with one."""
    s = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    s = re.sub(" +", " ", s)
    if not s.strip():
        return Counter()
    out = Counter(c for c in s if c != " ")
    out.update(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    return out


def by_rank(counts, most):
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]


def test_language_against_plain_distances(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        if r["lang"] is not None and r["text"] is not None and brute.bucket(r["doc_id"], 4) != 2:
            counts.setdefault(r["lang"], Counter()).update(n_grams(r["text"]))
    profiles = {k: by_rank(v, langid.PROFILE) for k, v in counts.items()}
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs) and len(profiles) > 2
    for r in docs:
        top = by_rank(n_grams(r["text"]), langid.DOC)
        if not top:
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0.0
            continue
        away = {}
        for lang, profile in profiles.items():
            place = {g: i for i, g in enumerate(profile)}
            away[lang] = sum(abs(place[g] - i) if g in place else langid.MISSING for i, g in enumerate(top))
        first, second = sorted(away, key=lambda k: (away[k], k))[:2]
        assert got[r["doc_id"]]["lang_pred"] == first
        assert got[r["doc_id"]]["score"] == pytest.approx(away[second] / (away[first] + away[second]))


def statistics(text):
    """The classifier's statistics, word by word, over UTF-8 bytes."""
    text = text or ""
    raw, words = text.encode(), brute.words(text)
    low, bytes_ = [brute.lower(w) for w in words], sum(len(w.encode()) for w in words)
    many, total = max(1, len(words)), max(1, len(raw))
    inside = max(1, bytes_)
    count = lambda chars: sum(text.count(c) for c in chars)
    lines = [x for x in text.split("\n") if brute.words(x)]
    n_lines = max(1, len(lines))
    upper, lower = (sum(c.isascii() and f(c) for c in text) for f in (str.isupper, str.islower))
    first, second = (lambda w: w.encode()[:1]), (lambda w: w.encode()[1:2])
    big = lambda b: len(b) == 1 and 65 <= b[0] <= 90
    distinct = 1 - (len(low) - len(set(low))) / many
    out = {
        "f_words": math.log1p(len(words)), "f_word_chars": inside / many, "f_symbols": count("#*$%&|<>@^~=+{}[]\\/_") / inside, "f_digits": count("0123456789") / inside,
        "f_punct": count("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") / inside, "f_upper": upper / max(1, upper + lower), "f_bang": text.count("!") / many, "f_pipe": text.count("|") / many,
        "f_white": 1 - inside / total, "f_distinct": distinct, "f_next_same": sum(a == b for a, b in zip(low, low[1:])) / many, "f_top_gap": distinct * math.sqrt(many),
        "f_caps_words": sum(big(first(w)) and big(second(w)) for w in words) / many, "f_sym_words": sum(w[-1] in "#*$%&|<>@^~=+{}[]\\/_" for w in words) / many,
        "f_line_words": len(words) / n_lines, "f_dup_lines": (len(lines) - len(set(lines))) / n_lines,
        "f_line_end": sum(x[-1] in ".!?:;\"')" for x in lines) / n_lines,
    }
    for k in (3, 5, 10):
        seen = Counter(tuple(low[i : i + k]) for i in range(len(low) - k + 1))
        out[f"f_dup_{k}"] = len({j for i in range(len(low) - k + 1) if seen[tuple(low[i : i + k])] > 1 for j in range(i, i + k)}) / many
    return [out[f] for f in quality.FEATURES]


def plain_score(model, x):
    z = model[0] + sum(w for path, w in model[1] if all((x[f] > cut) == above for f, cut, above in path))
    return 1 / (1 + math.exp(-z))


def test_quality_against_plain_rules(spark, rows):
    """Statistics word by word, and the learned rules one by one, against the compiled column."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    assert len(model[1]) > 3
    texts = [r["text"] for r in docs.collect()] + [r[1] for r in rows]
    data, off = textkit.text_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    x = quality.features(data, off)
    for k, t in enumerate(texts):
        assert x[k] == pytest.approx(statistics(t), abs=1e-9), (k, (t or "")[:60])
    got = {r["doc_id"]: r for r in quality.op5_quality_rules(spark, SMALL).collect()}
    for k, r in enumerate(docs.collect()):
        want = plain_score(model, x[k])
        assert got[r["doc_id"]]["score"] == pytest.approx(want) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


def plain_lines(rows):
    """Texts without the lines that more than 1 in ONE_IN distinct pages of their source share."""
    pages = {}
    for source, text in {(r["source"], r["text"]) for r in rows if r["text"] is not None}:
        pages.setdefault(source, []).append({x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")} - {""})
    drop = {s: {x for x, n in Counter(x for p in ps for x in p).items() if n >= linededup.MIN_PAGES and n * linededup.ONE_IN > len(ps)} for s, ps in pages.items()}
    return [r["text"] and "\n".join(x for x in r["text"].split("\n") if x.strip(" \t\n\x0b\x0c\r") not in drop[r["source"]]) for r in rows]


def test_pipeline_against_plain_stages(spark):
    """Each stage on what a plain reading of the stages before it leaves."""
    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model, rows = quality.learn(docs, labels), docs.collect()
    data, off = textkit.text_bytes(pa.array([r["text"] or "" for r in rows], pa.large_string()))
    x = quality.features(data, off)
    want = [r for k, r in enumerate(rows) if plain_score(model, x[k]) >= 0.7]
    stage = store.stash(P.quality_classifier(spark, docs, SMALL), "t")
    assert sorted(stage.collect(), key=repr) == sorted(want, key=repr) and 0 < len(want) < len(rows)

    lines = dict(zip((r["doc_id"] for r in want), plain_lines(want)))
    stage = store.stash(P.line_dedup(spark, stage, SMALL), "t")
    got = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert got == lines and any(lines[r["doc_id"]] != r["text"] for r in want)

    kept = {d for d, _, c, _ in brute.components(sorted(lines.items())) if c == d}
    stage = store.stash(P.near_duplicates(spark, stage, SMALL), "t")
    assert {r["doc_id"] for r in stage.collect()} == kept and len(kept) < len(lines)

    clean = lambda t: " ".join(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in brute.words(brute.lower(t)))
    items = [clean(r["text"]) for r in bench.collect() if r["text"]]
    whole = {d for d in kept if any(f" {i} " in f" {clean(lines[d])} " for i in items)}
    flagged = {r["doc_id"]: r for r in leaks.leaks(stage, bench).where("contaminated").collect()}
    left = store.stash(P.decontamination(spark, stage, SMALL), "t")
    assert {r["doc_id"] for r in left.collect()} == kept - set(flagged) and whole <= set(flagged)
    by_id = {r["item_id"]: clean(r["text"]).split() for r in bench.collect()}
    for d, r in flagged.items():  # what goes holds the passage that it is dropped for
        item = by_id[r["item_id"]]
        assert brute.lcs(item, clean(lines[d]).split()) >= 0.6 * min(len(item), leaks.WINDOW)

    left = left.collect()
    sizes = Counter()
    for r in left:
        sizes[r["source"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in P.mixing_sources(spark, spark.createDataFrame(left, docs.schema), SMALL).collect():
        taken[r["source"]] += r["n_words"]
        assert r["text"] in lines[r["doc_id"]]
    targets = brute.mix_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 0.5 + 1e-9 for s in sizes)

