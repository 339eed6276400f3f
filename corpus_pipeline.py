"""The corpus pipeline: quality, line dedup, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. Any other columns of docs pass through the filters, also such as clash with names used in
a stage. n_chars follows the text.

Nulls: a null text is judged as an empty one by the classifier, has no lines, links with nothing, holds no benchmark passage and gives
the mix nothing; a null doc_id, lang or source is a value of its own. Long texts are read whole by every stage. Rows that repeat
doc_id and text are one document from the near-duplicate stage on, the one whose columns hash least; rows that share a doc_id but not
the text are told apart by the text. Ties: a score on the cut is kept; of equal texts the least doc_id stays. Empty tables give empty
tables; without labels or benchmark rows the stages that need them accept by the share of label 1 (0.5, below the cut) and drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlane.llm import leaks, linededup, mixing, neardup, quality, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble accepts."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents of a source share; keeps every document."""
    out = linededup.line_dedup(docs)
    n_lines, n_dropped = (store.free_name(x, docs.columns) for x in ("n_lines", "n_dropped"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(n_lines, n_dropped)


def _rows(docs: DataFrame, these: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id and text_hash are in `these` (left_semi) or not (left_anti)."""
    key, mark = store.free_name("these_id", docs.columns), store.free_name("these_hash", docs.columns)
    these = these.select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct()
    return docs.join(these, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(mark)), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id; of rows that repeat it, the one whose columns hash least."""
    found = store.stash(neardup.near_duplicates(docs), "near")
    left = _rows(docs, found.where(~F.col("kept")), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return left
    row, mark = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), store.free_name("mark", docs.columns)
    few = _rows(left, again, "left_semi").select(row.alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.sha2(F.to_json(row), 256).alias(mark))
    few = few.groupBy("id", "text_hash").agg(F.min_by("row", mark).alias("row")).select("row.*")
    return _rows(left, again, "left_anti").union(few)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    found = leaks.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _rows(docs, found.where("contaminated"), "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in blocks of words: shard, slot, first, source, doc_id, first_word, n_words, text."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: The classifier, sketches and retrieval have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
