"""Benchmark leaks: planted passages, paraphrases and answers, blocks of items, the index against all pairs, the basis against an exact SVD."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlane.llm import leaks

from ..conftest import MEDIUM, SMALL
from . import brute


@pytest.mark.parametrize("most", [leaks.ITEMS, 9])
def test_leaks(spark, docs, rows, empty, monkeypatch, most):
    monkeypatch.setattr(leaks, "ITEMS", most)
    rng = random.Random(8)
    pool = [f"word{i}" for i in range(800)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(k, " ".join(text(30)) + ".") for k in range(20)] + [(50, None), (51, ""), (52, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made, want = [], {}
    for k in range(60):
        body = text(rng.choice([0, 40, 300]))
        item = brute.words(items[k % 20][1])
        if k < 40:
            if k >= 20:  # a paraphrase: a fifth of the words differ
                item = [w if rng.random() > 0.2 else rng.choice(pool) for w in item]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + item + body[at:]
            want[k] = k % 20
        made.append((k, " ".join(body).upper() if k % 2 else " ".join(body)))
    got = {r["doc_id"]: r for r in leaks.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    assert len(got) == 60
    for k, r in got.items():
        assert r["contaminated"] == (k in want) and r["kept"] != r["contaminated"] and (k not in want or r["item_id"] == want[k])
    out = leaks.leaks(docs, bench)
    assert out.count() == len(rows) and out.where("contaminated").count() == 0
    assert leaks.leaks(empty, bench).count() == 0
    assert leaks.leaks(docs, bench.limit(0)).where("kept").count() == len(rows)


def test_answers(spark):
    q = "which colour has the sky over the sea at noon in the summer of that year"
    bench = spark.createDataFrame([(1, q, "deep azure")], "item_id long, text string, answer string")
    made = [(1, f"intro words {q} it was deep azure of course"), (2, f"intro words {q} nobody knows that at all")]
    got = {r["doc_id"]: r["contaminated"] for r in leaks.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("most", [leaks.ITEMS, 9])
def test_passages_of_long_items(spark, monkeypatch, most):
    """A contiguous passage counts however long its item is, wherever in it the passage stands."""
    monkeypatch.setattr(leaks, "ITEMS", most)
    rng = random.Random(4)
    pool = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    items = {1: text(100), 2: text(400), 3: text(49), 4: text(1000)}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    made, want = [], {}
    for k, n in ((1, 50), (2, 200), (2, 50), (3, 49), (4, 50), (4, 300)):
        for at in (0, (len(items[k]) - n) // 3, len(items[k]) - n):
            want[len(made)] = k
            made.append((len(made), " ".join(text(90) + items[k][at : at + n] + text(60))))
    for k in items:  # a few words of an item are no passage
        made.append((len(made), " ".join(text(90) + items[k][:12] + text(60))))
    made += [(len(made) + i, " ".join(text(200))) for i in range(5)]
    got = {r["doc_id"]: r["item_id"] for r in leaks.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).where("contaminated").collect()}
    assert got == want


def test_answers_of_long_items(spark):
    item = [f"word{i}" for i in range(150)]
    bench = spark.createDataFrame([(1, " ".join(item), "deep azure")], "item_id long, text string, answer string")
    rest = " ".join(f"other{i}" for i in range(70))
    made = [(1, " ".join(item[:50]) + f" {rest} deep azure"), (2, " ".join(item[:50]) + f" {rest} nobody knows")]
    got = {r["doc_id"]: r["contaminated"] for r in leaks.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False}


def test_longest_common():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert leaks.longest_common(masks, len(a), b) == brute.lcs(a, b)


def test_leaks_recall_against_brute_force(spark):
    """Every document that holds a whole item is found, and no other."""
    docs, bench = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [" ".join(brute.words(brute.lower(r["text"]))) for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(f" {i} " in f" {' '.join(brute.words(brute.lower(r['text'])))} " for i in items)}
    got = {r["doc_id"] for r in leaks.op9_decontaminate(spark, MEDIUM).where("contaminated").collect()}
    assert want <= got and len(got - want) <= 0.1 * len(want)


POOL = [f"word{i}" for i in range(4000)]


def made_site(rng, n_items, n_docs, words=30):
    """Items of random words; documents of which every third holds one, its words replaced at a rate of its own."""
    text = lambda n: [rng.choice(POOL) for _ in range(n)]
    items = {k: text(words) for k in range(n_items)}
    docs, want = [], {}
    for d in range(n_docs):
        body = text(rng.choice([20, 150, 400]))
        if d % 3 == 0:
            k, rate = rng.randrange(n_items), (d // 3 % 5) / 10
            item = list(items[k])
            for i in rng.sample(range(words), round(rate * words)):
                item[i] = rng.choice(POOL)
            at = rng.randrange(len(body) + 1)
            body, want[d] = body[:at] + item + body[at:], (k, rate)
        docs.append((d, " ".join(body)))
    return [(k, " ".join(v)) for k, v in items.items()], docs, want


def test_recall_of_paraphrases(spark):
    """Share of items found by the share of their words replaced; at 40 % only the subsequence is exactly at its bound."""
    items, docs, want = made_site(random.Random(11), 150, 1500)
    got = {r["doc_id"]: r["item_id"] for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert all(d in want and want[d][0] == k for d, k in got.items())
    recall = {rate: sum(d in got for d in want if want[d][1] == rate) / sum(w[1] == rate for w in want.values()) for rate in (0.0, 0.1, 0.2, 0.3, 0.4)}
    assert recall[0.0] == recall[0.1] == recall[0.2] == 1 and recall[0.3] >= 0.98 and recall[0.4] >= 0.4, recall


def test_one_result_whatever_the_number_of_items(spark):
    """20 000 items are one block, 20 001 two: the same documents with the same items."""
    items, docs, want = made_site(random.Random(12), 20001, 300)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = []
    for n in (20000, 20001):
        bench = spark.createDataFrame(items[:n], "item_id long, text string")
        found.append({r["doc_id"]: r["item_id"] for r in leaks.leaks(docs, bench).where("contaminated and item_id < 20000").collect()})
    assert found[0] == found[1] and sum(d in found[0] for d in want) >= 0.8 * len(want)


def test_index_against_all_pairs(spark, monkeypatch):
    """Without the cosine bound the index must name every pair that passes the last check."""
    monkeypatch.setattr(leaks, "LEAST_COSINE", -1.0)
    rng = random.Random(13)
    pool = [f"w{i}" for i in range(60)]  # words so frequent that many pairs come near the bounds
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, text(rng.choice([3, 7, 12, 20])), None if k % 2 else text(3)) for k in range(60)]
    docs = [(d, text(rng.choice([0, 10, 60, 150]))) for d in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    got = {r["doc_id"] for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).where("contaminated").collect()}
    vocabulary = sorted({w for _, t, a in items for w in f"{t} {a or ''}".split()})
    df, total = dict.fromkeys(vocabulary, 0), 0
    for _, t in docs:
        w = t.split()
        for i in range(0, len(w), leaks.WINDOW):
            total += 1
            for x in set(w[i : i + leaks.WINDOW]) & set(vocabulary):
                df[x] += 1
    idf = {w: max(1e-3, float(np.log((total + 1) / (n + 1)))) for w, n in df.items()}
    want = set()
    for d, t in docs:
        w = t.split()
        for start in range(-leaks.WINDOW // 2, len(w), leaks.WINDOW // 2):
            near = w[max(0, start - leaks.WINDOW) : max(0, start + 2 * leaks.WINDOW)]
            for _, item, answer in items:
                item, keys = item.split(), ({x: answer.split().count(x) for x in answer.split()} if answer else {x: idf[x] for x in item.split()})
                if not set(w[max(0, start) : max(0, start + leaks.WINDOW)]) & set(vocabulary):
                    continue
                if sum(v for x, v in keys.items() if x in near) >= 0.6 * sum(keys.values()) and brute.lcs(item, near) >= (0.6 if len(item) >= 8 else 0.95) * len(item):
                    want.add(d)
    assert 10 < len(want) < 110 and got == want


def test_ids_of_any_type_and_clashing_columns(spark):
    bench = spark.createDataFrame([("b", "one two three four five six seven eight nine", 1), ("a", "one two three four five six seven eight nine", 2), (None, "red green blue white black pink grey brown gold", 3), ("a", None, 4)] * 3, "item_id string, text string, doc_id int")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine y", "q", 0.5), (2, "red green blue white black pink grey brown gold", "q", 0.5), (3, "plain", None, None), (None, None, None, None)], "doc_id long, text string, item_id string, cosine double")
    for most in (20000, 2):
        leaks.ITEMS = most
        got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in leaks.leaks(docs, bench).collect()}
        assert got == {1: (True, "a"), 2: (True, None), 3: (False, None), None: (False, None)}
    leaks.ITEMS = 20000


def test_singular_vectors_against_exact():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 120)) + 0.01 * rng.standard_normal((300, 120))
    g = leaks.gaussians(rng.integers(0, 2**63, 120).astype(np.uint64), 40).astype(np.float64)
    assert abs(g.mean()) < 0.1 and abs(g.std() - 1) < 0.1
    u = leaks.singular_vectors(a.T @ (a @ g), g)[:, :20]
    exact = np.linalg.svd(a, full_matrices=False)[2][:20].T
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-6) and np.linalg.norm(u @ (u.T @ exact) - exact) < 0.05
    assert leaks.singular_vectors(np.zeros((5, 3)), g[:5, :3]).shape[0] == 5


def test_sums_in_rounds(spark):
    """Frequencies over many partitions, most of them empty, are those of one pass."""
    texts = [(i, " ".join(f"t{(i * j) % 37}" for j in range(i % 90))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(97).select("doc_id", "text", F.lit(1).cast("long").alias("text_hash"))
    vocabulary = np.unique(np.concatenate([h[1] for h in leaks._hashed([(0, " ".join(f"t{i}" for i in range(37)), None, 37)])]))
    coded = docs.mapInArrow(leaks.encode(vocabulary), "doc_id long, text_hash long, ids binary")
    df, total = leaks.frequencies(coded, len(vocabulary))
    cut = [set(t.split()[i : i + leaks.WINDOW]) for _, t in texts for i in range(0, len(t.split()), leaks.WINDOW)]
    assert total == len(cut) and sorted(df) == sorted(float(sum(f"t{k}" in c for c in cut)) for k in range(37))
