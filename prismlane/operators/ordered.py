"""Ordered operators per video: best of a window, streaks, segments, sampling, ranking. All are windows or grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prismlane.shared import stash


def best_per_window(df: DataFrame, key: str, ts: str, index: str, score: str, width: float) -> DataFrame:
    """The first of the highest scores in each window of `width` seconds; one partial aggregate, no sort."""
    rest = [c for c in df.columns if c != key]
    win = F.floor(F.col(ts) / F.lit(float(width)))
    out = df.groupBy(key, win.alias("window_id")).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(index))).alias("b"))
    return out.select(key, "window_id", "b.*")


def best_two_phase(df: DataFrame, key: str, ts: str, index: str, rank_by: str, score: str, width: float, floor: float, margin: float = 0.5) -> DataFrame:
    """The best `score` among each window's first by `rank_by`; all of the window compete where that one lies below floor + margin."""
    win = F.floor(F.col(ts) / F.lit(float(width)))
    w = W.partitionBy(key, "window_id").orderBy(F.desc(rank_by), index)
    r = df.withColumn("window_id", win).withColumn("rank_", F.row_number().over(w))
    first = F.max_by(F.struct(index, score), -F.col("rank_"))
    every = F.max_by(F.struct(index, score), F.struct(F.col(score), -F.col("rank_")))
    out = r.groupBy(key, "window_id").agg(first.alias("f"), every.alias("e"), F.count("*").alias("n"))
    again = (F.col("n") > 1) & (F.col(f"f.{score}") < floor + margin)
    return out.select(key, "window_id", F.when(again, F.col(f"e.{index}")).otherwise(F.col(f"f.{index}")).alias(index), again.alias("revisited"))


def stride_sample(df: DataFrame, index: str, step: int) -> DataFrame:
    return df.where(F.col(index) % max(1, step) == 0)


def sampling_step(fps: Column, per_second: float) -> Column:
    """Frames between samples: half-to-even rounding, 1 at least; an unknown rate counts as 25."""
    return F.greatest(F.lit(1), F.bround(F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(25.0)) / per_second).cast("int"))


def stride_step(fps: Column, seconds: float) -> Column:
    return F.greatest(F.lit(1), F.bround(F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(25.0)) * seconds).cast("int"))


def chunk_plan(videos: DataFrame, duration: str, chunk: float, most: float | None = None) -> DataFrame:
    """chunk_id, start_sec, end_sec for each video; one open chunk where the length is unknown."""
    d = F.least(F.col(duration), F.lit(float(most))) if most else F.col(duration)
    known = F.coalesce(d > 0, F.lit(False))
    n = F.when(known, F.ceil(d / F.lit(float(chunk))) - 1).otherwise(0).cast("int")
    out = videos.withColumn("d_", F.when(known, d)).withColumn("chunk_id", F.explode(F.sequence(F.lit(0), n)))
    start = F.col("chunk_id") * F.lit(float(chunk))
    return out.withColumn("start_sec", start).withColumn("end_sec", F.least(start + F.lit(float(chunk)), F.col("d_"))).drop("d_")


def adaptive_stride(df: DataFrame, key: str, index: str, value: str, least: float) -> DataFrame:
    """Drops samples that differ less than `least` from the previous sample; the first of a video stays."""
    motion = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(index)))
    return df.withColumn("motion", motion).where(F.col("motion").isNull() | (F.col("motion") >= least))


def hit_streaks(df: DataFrame, key: str, index: str, match: str, n: int) -> DataFrame:
    """Matching samples from the n-th of a run of matches on."""
    w = W.partitionBy(key).orderBy(index)
    m = F.col(match).cast("int")
    df = df.withColumn("isle_", F.row_number().over(w) - F.sum(m).over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.where(F.col(match)).withColumn("streak", F.row_number().over(W.partitionBy(key, "isle_").orderBy(index)))
    return df.where(F.col("streak") >= n).drop("isle_")


def hits_to_segments(hits: DataFrame, key: str, ts: str, sim: str, gap: float, pre: float, post: float, end: Column | None = None) -> DataFrame:
    """Hits no further apart than `gap` are one segment, padded afterwards, so segments may overlap; empty ones go."""
    w = W.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(1))
    isles = hits.withColumn("new_", new).withColumn("isle_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    extra = [F.max(end).alias("end_")] if end is not None else []
    out = isles.groupBy(key, "isle_").agg(F.min(ts).alias("a_"), F.max(ts).alias("b_"), F.count("*").alias("hits"), F.max(sim).alias("best_sim"), *extra)
    a, b = F.col("a_") - pre, F.col("b_") + post
    if end is not None:
        a, b = F.greatest(F.lit(0.0), a), F.least(F.col("end_"), b)
    return out.withColumn("start_sec", a).withColumn("end_sec", b).where("end_sec > start_sec").select(key, "start_sec", "end_sec", "hits", "best_sim")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Unions of intervals whose starts lie within `gap` of the furthest end so far."""
    w = W.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    isles = df.withColumn("new_", F.coalesce((F.col(start) > far + gap).cast("int"), F.lit(1)))
    isles = isles.withColumn("isle_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return isles.groupBy(key, "isle_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("isle_")


def build_segments(times: DataFrame, key: str, ts: str, pre: float, post: float, gap: float, min_dur: float, longest: Column | None = None) -> DataFrame:
    """Each time padded to an interval of min_dur at least, then merged; intervals of 0.05 s or less go."""
    t = F.col(ts)
    s, e = F.greatest(F.lit(0.0), t - pre), t + post
    if longest is not None:
        e = F.least(longest, e)
    short = (e - s) < min_dur
    s2 = F.greatest(F.lit(0.0), t - min_dur / 2.0)
    e2 = s2 + min_dur
    if longest is not None:
        over = e2 > longest
        s2, e2 = F.when(over, F.greatest(F.lit(0.0), longest - min_dur)).otherwise(s2), F.when(over, longest).otherwise(e2)
    iv = times.select(key, F.when(short, s2).otherwise(s).alias("start_sec"), F.when(short, e2).otherwise(e).alias("end_sec"))
    return merge_intervals(iv, key, "start_sec", "end_sec", gap).where("end_sec > start_sec + 0.05")


def presence_intervals(frames: DataFrame, key: str, index: str, start: float, end: float, fps: float, pad: float = 0.15) -> DataFrame:
    """Times of detections within [start, end), relative to start, padded and merged where the gap to the padded end is small."""
    lo, hi = round(start * fps), round(end * fps)
    length, near = max(0.0, end - start), max(0.20, 3.0 / max(1.0, fps))
    t = F.greatest(F.lit(0.0), F.least(F.lit(length), F.col(index) / F.lit(float(fps)) - F.lit(float(start))))
    rows = frames.where((F.col(index) >= lo) & (F.col(index) < hi)).select(key, t.alias("t_"))
    iv = rows.select(key, "t_", F.greatest(F.lit(0.0), F.col("t_") - pad).alias("start_sec"), F.least(F.lit(length), F.col("t_") + pad).alias("end_sec"))
    w = W.partitionBy(key).orderBy("t_")
    far = F.max("end_sec").over(w.rowsBetween(W.unboundedPreceding, -1))
    iv = iv.withColumn("new_", F.coalesce((F.col("t_") - far > near).cast("int"), F.lit(1))).withColumn("isle_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = iv.groupBy(key, "isle_").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).where("end_sec > start_sec").drop("isle_")
    return merge_intervals(first, key, "start_sec", "end_sec", near)


def ranked(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def numbered(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    """As ranked, for groups of any size: rows are sorted by ranges, counted per range and numbered within it; keys aren't null."""
    rows = stash(df.orderBy(*keys, *order).withColumn("id_", F.monotonically_increasing_id()), "numbered").withColumn("part_", F.shiftright("id_", 33))
    sizes = rows.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    prior = F.sum("n_").over(W.partitionBy(*keys).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(sizes.withColumn("before_", F.coalesce(prior, F.lit(0))).drop("n_"), [*keys, "part_"])
    place = F.row_number().over(W.partitionBy(*keys, "part_").orderBy("id_"))
    return rows.withColumn(out, F.col("before_") + place).drop("id_", "part_", "before_")


def keep_budget(seconds: Column, per_image: float, cap: float | None = None) -> Column:
    usable = F.least(seconds, F.lit(float(cap))) if cap else seconds
    return F.greatest(F.lit(1), F.floor(usable / F.lit(float(per_image))).cast("int"))


def detect_schedule(df: DataFrame, key: str, index: str, every: int, live: str | None = None) -> DataFrame:
    """Adds `detect`: every k-th sample of a video, and samples without a live track."""
    k = F.row_number().over(W.partitionBy(key).orderBy(index)) - 1
    on = k % max(1, every) == 0
    return df.withColumn("detect", on if live is None else on | ~F.col(live))


def seek_sample(videos: DataFrame, key: str, frames: str, fps: str, start: float, stride: float, most: float | None = None) -> DataFrame:
    """Frame numbers from start on, every stride seconds, before `most` seconds; rounding is half to even."""
    step = F.greatest(F.lit(1), F.bround(F.col(fps) * stride).cast("int"))
    first = F.least(F.col(frames), F.bround(F.col(fps) * start).cast("int"))
    out = videos.where(first < F.col(frames)).select(key, F.col(fps).alias("fps_"), F.explode(F.sequence(first, F.col(frames) - 1, step)).alias("frame_index"))
    out = out.withColumn("timestamp_sec", F.col("frame_index") / F.col("fps_")).drop("fps_")
    return out if most is None else out.where(F.col("timestamp_sec") < most)


def largest_boxes(df: DataFrame, keys: list[str], width: str, height: str, most: int, ids: str) -> DataFrame:
    area = F.col(width) * F.col(height)
    return ranked(df, keys, [area.desc(), ids]).where(F.col("rank") <= most)
