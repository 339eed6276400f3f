"""Range, as-of, interval and similarity joins as equi joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prismlane.functions import vectors as V


def within(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, width: float) -> DataFrame:
    """Pairs of one key with |lt - rt| <= width: the left side goes to three buckets, the right to one, then an equi join."""
    b = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    l3 = left.withColumn("b_", F.explode(F.array(b(lt) - 1, b(lt), b(lt) + 1)))
    return l3.join(right.withColumn("b_", b(rt)), [key, "b_"]).where(F.abs(F.col(lt) - F.col(rt)) <= width).drop("b_")


def nearest(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, tolerance: float) -> DataFrame:
    """Each left row with the nearest right time within tolerance, the later one on a tie, else null.

    Both sides are one sorted stream per key; the last time before and the first time after are window functions over it.
    """
    cols = [c for c in left.columns if c != key]
    a = left.select(key, F.col(lt).alias("t_"), F.lit(None).cast(right.schema[rt].dataType).alias("r_"), F.struct(*cols).alias("row_"))
    b = right.select(key, F.col(rt).alias("t_"), F.col(rt).alias("r_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_")).distinct()
    w = W.partitionBy(key).orderBy("t_")
    both = a.unionByName(b).withColumn("p_", F.last("r_", True).over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("n_", F.first("r_", True).over(w.rangeBetween(0, W.unboundedFollowing)))
    before, after = F.col("t_") - F.col("p_"), F.col("n_") - F.col("t_")
    best = F.when(F.col("n_").isNull() | (before < after), F.col("p_")).otherwise(F.col("n_"))
    got = both.where("row_ is not null").withColumn("m_", best).withColumn("m_", F.when(F.abs(F.col("m_") - F.col("t_")) <= tolerance, F.col("m_")))
    return got.select(key, "row_.*", F.col("m_").alias("matched"))


def overlaps(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals (s, e) and (s2, e2) of one key, once each: they meet in the bucket of the later start."""
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / F.lit(float(width))), F.floor(F.col(e) / F.lit(float(width)))))
    x, y = a.withColumn("b_", bucket("s", "e")), b.withColumn("b_", bucket("s2", "e2"))
    meet = F.floor(F.greatest("s", "s2") / F.lit(float(width))) == F.col("b_")
    return x.join(y, [key, "b_"]).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & meet).drop("b_")


def near_hashes(rows: DataFrame, queries: DataFrame, h: str, q: str, bits: int) -> DataFrame:
    """Pairs whose 64-bit hashes differ in `bits` (7 at most) places: of four 16-bit words one then differs in one place at most.

    Rows go to the buckets of their four words, queries to the 17 words near each of theirs: an exact equi join on 2^18 keys.
    """
    if bits > 7:
        raise ValueError("more than 7 bits need shorter words")
    word = lambda c, k: F.shiftright(F.col(c), 16 * k).bitwiseAND(F.lit(65535))
    near = [F.lit(0), *[F.lit(1 << j) for j in range(16)]]
    a = rows.withColumn("w_", F.explode(F.array(*[word(h, k) * 4 + k for k in range(4)])))
    b = queries.withColumn("w_", F.explode(F.array(*[word(q, k).bitwiseXOR(n) * 4 + k for k in range(4) for n in near])))
    return a.join(b, "w_").where(V.hamming(F.col(h), F.col(q)) <= bits).drop("w_").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, key: list[str], lv: str, rv: str, least: float) -> DataFrame:
    """Pairs of one key (a video, a scope) whose unit vectors have a dot product of `least` or more; the key bounds the pairs."""
    return left.join(right, key).withColumn("sim", V.dot(F.col(lv), F.col(rv))).where(F.col("sim") >= least)


def top_similar(rows: DataFrame, queries: DataFrame, ids: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """query_id, ids, sim, rank: the k nearest rows of each query by dot product, itself left out, ties to the smaller id.

    Rows and queries meet in blocks of `block`; each pair of blocks gives k rows a query at most, so what is sorted per query is k
    times the number of row blocks, not the number of rows.
    """
    import numpy as np
    import pandas as pd

    place = F.floor(F.col(ids) / F.lit(float(block))).alias("block_")
    a = rows.groupBy(place).agg(F.collect_list(ids).alias("ra_"), F.collect_list(V.doubles(F.col(vec))).alias("va_")).withColumnRenamed("block_", "rows_")
    n = max(1, -(-queries.count() // block))
    q = queries.groupBy(F.pmod(F.xxhash64(ids), F.lit(n)).alias("block_")).agg(F.collect_list(ids).alias("rb_"), F.collect_list(V.doubles(F.col(vec))).alias("vb_"))
    pairs = a.withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(q, "block_").select("ra_", "va_", "rb_", "vb_")

    def best(batches):
        for pdf in batches:
            for ra, va, rb, vb in pdf.itertuples(index=False, name=None):
                ra, rb = np.asarray(ra), np.asarray(rb)
                sims = np.round(np.stack(vb) @ np.stack(va).T, 6)
                sims[rb[:, None] == ra[None, :]] = -np.inf
                for i in range(len(rb)):
                    top = np.lexsort((ra, -sims[i]))[:k]
                    top = top[sims[i, top] > -np.inf]
                    yield pd.DataFrame({"query_id": rb[i], ids: ra[top], "sim": sims[i, top]})

    found = pairs.mapInPandas(best, f"query_id long, {ids} long, sim double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), ids))).where(F.col("rank") <= k)


def not_in_index(candidates: DataFrame, index: DataFrame, key: list[str], vec: str, threshold: float) -> DataFrame:
    """Candidates further than threshold from every index vector of the same key."""
    i = index.select(*key, F.col(vec).alias("iv_"))
    near = V.cosine_distance(F.col(vec), F.col("iv_")) < threshold
    on = [candidates[k] == i[k] for k in key]
    cond = near
    for o in on:
        cond = cond & o
    return candidates.join(i, cond, "left_anti")


def match_queries(faces: DataFrame, queries: list[list[float]], centroid: list[float], vec: str, least: float, margin: float, every: bool = True) -> DataFrame:
    """Similarities of each row to a few query vectors, given as literals: no join at all."""
    sims = F.array(*[V.dot(F.col(vec), F.array(*map(F.lit, q))) for q in queries])
    out = faces.withColumn("sims_", sims).withColumn("smin", F.array_min("sims_")).withColumn("smax", F.array_max("sims_"))
    out = out.withColumn("scentre", V.dot(F.col(vec), F.array(*map(F.lit, centroid)))).drop("sims_")
    return out.withColumn("hit", (F.col("smin" if every else "smax") >= least) & (F.col("scentre") >= least - margin))
