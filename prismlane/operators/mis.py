"""Greedy de-duplication without a sequential pass: the lexicographically first independent set of the similarity graph.

A row is kept if all its better-ranked neighbours are dropped, dropped if one is kept; each round decides every row whose better
neighbours are decided. The result equals the sequential fold. Only edges and undecided ids move, so no group has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlane.functions import vectors as V
from prismlane.shared import discard, stash


def similarity_edges(df: DataFrame, key: str, ids: str, rank: str, vec: str, threshold: float) -> DataFrame:
    """(key, better, worse) for pairs of one key closer than threshold."""
    a = df.select(key, F.col(ids).alias("better"), F.col(rank).alias("ra_"), F.col(vec).alias("va_"))
    b = df.select(key, F.col(ids).alias("worse"), F.col(rank).alias("rb_"), F.col(vec).alias("vb_"))
    near = V.cosine_distance(F.col("va_"), F.col("vb_")) < threshold
    return a.join(b, key).where(F.col("ra_") < F.col("rb_")).where(near).select(key, "better", "worse")


def greedy_independent(df: DataFrame, edges: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, ids) of the rows that a greedy pass in rank order keeps."""
    todo, edges = stash(df.select(key, ids), "todo"), stash(edges, "edges")
    kept: list[DataFrame] = []
    while not todo.isEmpty():
        blocked = edges.select(key, F.col("worse").alias(ids)).distinct()
        kept.append(stash(todo.join(blocked, [key, ids], "left_anti"), "kept"))  # each round writes its own rows only
        now = kept[-1].select(key, F.col(ids).alias("better"))
        out = edges.join(now, [key, "better"], "left_semi").select(key, F.col("worse").alias(ids)).distinct()
        gone = out.union(now.select(key, F.col("better").alias(ids)))
        before, todo = (todo, edges), stash(todo.join(gone, [key, ids], "left_anti"), "todo")
        left = todo.select(key, F.col(ids).alias("better"))
        edges = stash(edges.join(left, [key, "better"], "left_semi").join(left.withColumnRenamed("better", "worse"), [key, "worse"], "left_semi").select(key, "better", "worse"), "edges")
        discard(*before)
    out = todo
    for part in kept:
        out = out.union(part)
    return out
