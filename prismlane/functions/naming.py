"""Names and texts of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9_-]", "_")


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))


def frame_file(index: Column, ts: Column) -> Column:
    return F.format_string("%09d_t%.2f.jpg", index, ts)


def without_clashes(df: DataFrame, name: str, order: list, out: str = "file") -> DataFrame:
    """name, or name_1, name_2 ... for later rows of the same name (before its extension)."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    stem, ext = F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    return df.withColumn("k_", k).withColumn(out, F.when(F.col("k_") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("k_").cast("string"), ext))).drop("k_")


def detail_slug(reason: Column, details: dict[str, Column]) -> Column:
    """reason__key-value__key-value, keys sorted, odd characters as underscores."""
    parts = [F.concat(F.lit(f"{k}-"), F.regexp_replace(v.cast("string"), "[^A-Za-z0-9_.-]", "_")) for k, v in sorted(details.items())]
    return F.concat_ws("__", slug(reason), *parts)


def in_root(video: Column, file: Column) -> Column:
    """The name of a selected file in the common folder."""
    return F.concat_ws("__", F.regexp_replace(F.regexp_extract(video, r"([^/]*)$", 1), r"\.[^.]*$", ""), file)
