"""Sinks: tables with replace, upsert and insert-if-absent rules, text tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prismlane.functions.scores import text_number


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and those new rows whose key it lacks; of new rows with one key, one."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer merge; a null in the new row keeps the stored value."""
    rest = [c for c in stored.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest])
    return stored.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in rest])


def without_videos(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def write_frames(df: DataFrame, path: str, key: str = "video_id") -> None:
    """Replaces the partitions of the videos in df, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, digits: dict[str, int]) -> None:
    """Fixed numbers of decimals."""
    df.select(*[F.format_string(f"%.{digits[c]}f", c).alias(c) if c in digits else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def decision_lines(df: DataFrame) -> DataFrame:
    """One tab-separated line a decision: status, video, frame, time, scores (NA where missing), reason. Without a status, video or frame the line is null; fields never move up."""
    numbers = [F.concat(F.lit(f"{c}="), text_number(F.col(c))) for c in ("ts", "clip", "nima", "piq", "overall")]
    fields = ["status", "video", F.concat(F.lit("frame="), F.col("frame")), *numbers, F.concat(F.lit("reason="), F.coalesce("reason", F.lit("NA")))]
    return df.select(F.concat(*[x for f in fields for x in (F.lit("\t"), f)][1:]).alias("value"))


def markdown(df: DataFrame, name: str, scores: list[str]) -> DataFrame:
    """Rows of a table; the header is markdown_header."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name), *[text_number(F.col(c), 3, "N/A") for c in scores]), F.lit(" |")).alias("value"))


def markdown_header(name: str, scores: list[str]) -> list[str]:
    return ["| " + " | ".join([name, *scores]) + " |", "|" + "---|" * (len(scores) + 1)]


def clip_manifest(segments: DataFrame, key: str, out: str = "clips") -> DataFrame:
    """clip_000.mp4 ... per key in time order, for segments longer than 0.05 s."""
    n = F.row_number().over(W.partitionBy(key).orderBy("start_sec", "end_sec")) - 1
    return segments.where("end_sec - start_sec > 0.05").withColumn("clip", F.format_string("clip_%03d.mp4", n)).withColumn("dir", F.concat(F.lit(f"{out}/"), F.col(key).cast("string")))


def gate_expression(intervals: DataFrame, key: str) -> DataFrame:
    """between(t,s,e)+... per key: the audio gate."""
    parts = intervals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec"))).alias("i_"))
    return parts.select(key, F.array_join(F.transform("i_", lambda x: F.format_string("between(t,%.3f,%.3f)", x["start_sec"], x["end_sec"])), "+").alias("gate"))
