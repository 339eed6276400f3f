"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent 1- to 3-grams of a language (letters lower-cased, all else one space, n-grams with an
inner space left out), ties by code point. Profiles are learned from about PER_LANG whole texts a language, chosen by a hash of
doc_id among rows with a language whose crc32(doc_id) mod 4 is not 2 (the only use of lang and doc_id); counts are summed on the
executors. A text's DOC most frequent n-grams are held against each profile: the distance is the sum of the rank differences,
MISSING for an n-gram that a profile lacks. The nearest language wins, ties by name. score = second / (first + second) distance,
1.0 if only one language was learned. A null text, one without a letter, or a table without languages gives `und` and 0.0. Whole
texts are read; each is judged alone. A null doc_id counts as the empty string for crc32. Repeated rows get equal results. An
empty table gives no rows; other columns pass through, clashing names get underscores.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import store, textkit as tk

store.by_value(tk.__name__)
store.by_value(__name__)

PER_LANG, PROFILE, DOC = 2000, 400, 400
MISSING = PROFILE
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as 63-bit codes, in order of place; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a = np.where(letters()[a], a, 32)
    if not (a != 32).any():
        return np.zeros(0, np.int64)
    a = np.concatenate([[32], a, [32]])
    gap = a == 32
    keep = ~gap
    keep[0] = True
    keep[1:] |= ~gap[:-1]
    a = a[keep]
    gap = a == 32
    two = (a[:-1] << 21) | a[1:]
    return np.concatenate([a[~gap], two, ((two[:-1] << 21) | a[2:])[~gap[1:-1]]])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, best first, ties by code."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(codes)))
    return codes[first[np.argsort(-count, kind="stable")[:most]]]


def _counted(batches):
    for batch in batches:
        for lang in sorted(set(batch.column("lang").to_pylist())):
            texts = batch.filter(pc.equal(batch.column("lang"), lang)).column("text").to_pylist()
            for k in range(0, len(texts), 64):
                codes, n = np.unique(np.concatenate([grams(t) for t in texts[k : k + 64]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def bucket(doc_id: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def profiles(docs: DataFrame, per_lang: int = PER_LANG) -> dict[str, list[int]]:
    """Language to codes, best first; PROFILE for each language at most."""
    train = docs.where("lang is not null and text is not null").where(bucket("doc_id", 4) != 2)
    # written first: its size is then known, so Spark sends it to the texts instead of dealing them by language
    share = store.stash(train.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")), "shares")
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    chosen = train.join(share, "lang").where(u < F.col("share")).select("lang", "text")
    counts = chosen.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= PROFILE)
    out: dict[str, list[int]] = {}
    for row in sorted(best.select("lang", "r", "code").collect()):
        out.setdefault(row["lang"], []).append(row["code"])
    return out


def identify(df: DataFrame, learned: dict[str, list[int]], text: str = "text") -> DataFrame:
    """df with lang_pred and score (more underscores where df has such columns)."""
    names = sorted(learned)
    known = np.unique(np.array([c for p in learned.values() for c in p], dtype=np.int64))
    rank = np.full((len(known) + 1, len(names)), MISSING + (1 << 20), dtype=np.int64)
    for k, lang in enumerate(names):
        rank[np.searchsorted(known, np.array(learned[lang], dtype=np.int64)), k] = np.arange(len(learned[lang]))
    pred, score = (store.free_name(c, df.columns) for c in ("lang_pred", "score"))

    def judge(t: str | None) -> tuple[str, float]:
        top = ranked(grams(t), DOC)
        if not len(top) or not names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        at = np.where(known[at] == top, at, len(known))
        away = np.minimum(np.abs(rank[at] - np.arange(len(top))[:, None]), MISSING).sum(axis=0)
        if len(names) == 1:
            return names[0], 1.0
        order = np.argsort(away, kind="stable")
        a, b = float(away[order[0]]), float(away[order[1]])
        return names[order[0]], (b / (a + b) if a + b else 0.5)

    def run(batches):
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column(text)]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, pred, score])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{pred}` string, `{score}` double"])
    return df.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = profiles(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
