"""Vector arithmetic on array columns, in doubles, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, least: float = 1e-9) -> Column:
    """v divided by its length, which counts as `least` at least."""
    return F.transform(doubles(v), lambda x: x / F.greatest(norm(v), F.lit(least)))


def cosine_distance(a: Column, b: Column) -> Column:
    """For unit vectors."""
    return F.lit(1.0) - dot(a, b)


def finite(v: Column, dim: int | None = None) -> Column:
    """No NaN or infinity, and the length asked for."""
    ok = ~F.exists(doubles(v), lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return ok if dim is None else ok & (F.size(v) == dim)


def hash_from_hex(h: Column) -> Column:
    """64 bits from 16 hex digits, as a signed long."""
    return F.conv(h, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: Column) -> Column:
    """64 bits: bit i is set where component i is positive."""
    bits = F.transform(F.slice(doubles(v), 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i)), F.expr("0L"), lambda s, x: s.bitwiseXOR(x))


def vector_mean(df: DataFrame, keys: list[str], vec: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean per group: exploded sums, so a group's vectors never meet in one task."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vec))).alias("pos_", "x_")).groupBy(*keys, "pos_").agg(F.avg("x_").alias("x_"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos_", "x_"))), lambda p: p["x_"]).alias(out))
