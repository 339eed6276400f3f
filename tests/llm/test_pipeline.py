"""The pipeline's stages on small rows, and run() against the stages called one by one."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from prismlane.llm import mixing, store

from ..conftest import SMALL
from . import brute


def test_stages_keep_columns(spark, docs, rows, empty):
    wide = docs.withColumn("gone_", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("score", F.lit(2.0))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns, name
        assert out.count() <= len(rows) and stage(spark, empty, SMALL).count() == 0
    assert P.STAGES[-1][1](spark, wide, SMALL).count() > 0 and P.STAGES[-1][1](spark, empty, SMALL).count() == 0


def test_near_duplicates_keep_one(spark, docs, rows):
    got = P.near_duplicates(spark, docs, SMALL).collect()
    want = {(d, n) for d, n, c, k in brute.components([(r[0], r[1]) for r in rows]) if k}
    assert {(r["doc_id"], len(brute.shingles(r["text"]))) for r in got} == want and len(got) == len(want)


def test_line_dedup_sets_lengths(spark):
    df = spark.createDataFrame([(i, f"text {i} of its own that is long enough\nfurniture", "en", "s", 999) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r["n_chars"] == len(r["text"]) for r in P.line_dedup(spark, df, SMALL).collect())


def test_line_dedup_treats_pages_of_furniture(spark):
    menu = "Subscribe to our weekly letter\nAll rights reserved by the publisher"
    df = spark.createDataFrame([(i, f"text {i}\n{menu}", "en", "s", 999) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r["text"], r["n_chars"]) for r in P.line_dedup(spark, df, SMALL).collect()} == {(f"text {i}", 6) for i in range(4)}


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = store.stash(stage(spark, docs, SMALL), "t")
        assert 0 < docs.count() <= before
        before = docs.count()
    want = mixing.mixed(docs).count()
    out = P.run(spark, SMALL)
    assert out.count() == want > 0
    text = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    for r in out.collect():
        assert brute.words(r["text"]) == text[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]


def test_everything_is_registered():
    import re

    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert [s for s, _ in P.STAGES] == ["quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]
