"""Counts, corpus totals, stored tables, text sinks, streams replayed as batches, and the statistics of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlane.sources import sinks as K
from prismlane.sources.tables import FRAMES_SQL, SCORES_SQL, frames, image_scores, load
from prismlane.streaming import flows as T

DAY = 86400.0


def table_counts(spark, d):
    one = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
    f = load(spark, d, "events")
    out = one("events", f).unionAll(one("embeddings", load(spark, d, "embeddings"))).unionAll(one("documents", load(spark, d, "documents")))
    return out.unionAll(f.agg(F.lit("clicks").alias("name"), F.count_if(F.col("event_type") == "click").alias("n")))


def corpus_totals(spark, d):
    f = frames(spark, d, vectors=False)
    v = f.groupBy("video_id").agg(F.max("timestamp_sec").alias("t"), F.count_if(F.col("aesthetic") >= 0.5).alias("k"))
    return v.agg(F.count("*").alias("videos"), F.sum("k").alias("selected"), F.round(F.sum("t"), 2).alias("total_seconds"))


def reason_cube(spark, d):
    f = frames(spark, d, vectors=False).withColumn("good", F.col("aesthetic") >= 0.5)
    return f.cube("event_type", "good").agg(F.count("*").alias("n"), F.round(F.avg("tech_score"), 4).alias("tech"))


def image_statistics(spark, d):
    """Mean, spread, histogram and distinct values per video, as of pixels."""
    f = frames(spark, d, vectors=False)
    g = f.groupBy("video_id").agg(F.round(F.avg("aesthetic"), 4).alias("mean"), F.round(F.stddev_pop("aesthetic"), 4).alias("std"), F.round(F.var_pop("aesthetic"), 4).alias("var"), F.round(F.max("aesthetic"), 6).alias("top"), F.countDistinct("tech_score").alias("n_distinct"), F.count_if(F.col("aesthetic") < 1).alias("dark"))
    return g


def value_histogram(spark, d):
    return load(spark, d, "events").groupBy(F.width_bucket("value", F.lit(0.0), F.lit(500.0), F.lit(16)).alias("bin")).agg(F.count("*").alias("n"))


def decision_lines(spark, d):
    s = image_scores(spark, d).select(F.lit("selected").alias("status"), F.concat(F.lit("v"), F.col("image_id")).alias("video"), F.col("image_id").alias("frame"), (F.col("image_id") / 4).alias("ts"), "clip", "nima", "piq", ((F.col("clip") + F.col("nima")) * F.col("piq")).alias("overall"), F.lit(None).cast("string").alias("reason"))
    return K.decision_lines(s)


def markdown_table(spark, d):
    return K.markdown(image_scores(spark, d).withColumn("image", F.concat("image_id", F.lit(".jpg"))), "image", ["clip", "nima", "brisque"])


def selected_mapping(spark, d):
    """out{n} and reject{n} in the order of the ids."""
    from prismlane.functions.scores import image_gate
    from prismlane.operators.ordered import numbered

    s = image_scores(spark, d).withColumn("ok", image_gate(F.col("clip"), F.col("nima"), F.col("piq")))
    return numbered(s, ["ok"], ["image_id"]).select("image_id", F.concat(F.when(F.col("ok"), "out").otherwise("reject"), F.col("rank").cast("string")).alias("name"))


def _replayed(spark, df, build, name: str, runs: int = 1):
    """The rows that a stream over df gives: df is stored in files, read as a stream to its end, collected by a file sink.

    A second run lets the watermark of the first close its windows.
    """
    from prismlane.shared import stash

    path = stash(df, name)._stash_path
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = build(stream)
    sink = f"{path}-{name}"
    for _ in range(runs):
        query = out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def streamed_streaks(spark, d):
    """The streak operator as a stream with state per video."""
    f = frames(spark, d, vectors=False).select("video_id", "frame_index", F.timestamp_seconds("timestamp_sec").alias("at"), (F.col("aesthetic") >= 0.5).alias("matched"))
    return _replayed(spark, f, lambda s: T.hit_streaks(s.withWatermark("at", "1 hour"), "video_id", "frame_index", "matched", 2, "video_id long, frame_index int", event_time="at"), "streaks")


def streamed_dedup(spark, d):
    """De-duplication against kept rows of the last five days, as a stream whose state is that window."""
    f = frames(spark, d).select("video_id", "frame_index", "timestamp_sec", F.timestamp_seconds("timestamp_sec").alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))
    return _replayed(spark, f, lambda s: T.lately_unseen(s.withWatermark("at", "1 hour"), "video_id", "timestamp_sec", "embedding", "frame_index", 5 * DAY, 0.4, "video_id long, frame_index int", event_time="at"), "unseen")


def _timed(spark, d):
    """Frames with event times, and one far row that closes the last windows."""
    f = frames(spark, d, vectors=False).select("video_id", "frame_index", "aesthetic", "event_id")
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    f = f.join(e, "event_id").drop("event_id")
    last = spark.range(1).select(F.lit(-1).cast("long").alias("video_id"), F.lit(0).alias("frame_index"), F.lit(9.0).alias("aesthetic"), F.lit("2035-01-01").cast("timestamp").alias("ts"))
    return f.unionByName(last)


def streamed_best(spark, d):
    """The first best frame of each day and video, emitted as the watermark closes the day."""
    out = _replayed(spark, _timed(spark, d), lambda s: T.best_per_window(s, "video_id", "ts", "frame_index", "aesthetic", "1 day"), "best", runs=2)
    return out.where("video_id >= 0").select("video_id", F.unix_micros("window_start").alias("window_us"), "frame_index")


def streamed_sessions(spark, d):
    out = _replayed(spark, _timed(spark, d).where("aesthetic >= 0.5"), lambda s: T.sessions(s, "video_id", "ts", "aesthetic", "6 hours"), "sessions", runs=2)
    return out.where("video_id >= 0").select("video_id", F.unix_micros("start_ts").alias("start_us"), "hits", F.round("best_sim", 6).alias("best_sim"))


QUERIES = {f.__name__: f for f in (table_counts, corpus_totals, reason_cube, image_statistics, value_histogram, decision_lines, markdown_table, selected_mapping, streamed_streaks, streamed_dedup, streamed_best, streamed_sessions)}
_F = f"f as materialized ({FRAMES_SQL})"
_n = "case when {0} is null then '{2}' else printf('%.{1}f', round(({0})::varchar::decimal(24, 12), {1})::double) end"
SQL = {
    "table_counts": "select 'events' as name, count(*) n from events union all select 'embeddings', count(*) from embeddings union all select 'documents', count(*) from documents union all select 'clicks', count(*) filter (where event_type = 'click') from events",
    "corpus_totals": f"with {_F}, v as (select video_id, max(timestamp_sec) t, count(*) filter (where aesthetic >= 5e-1) k from f group by video_id) select count(*) videos, sum(k)::bigint selected, round(sum(t), 2) total_seconds from v",
    "reason_cube": f"with {_F} select event_type, aesthetic >= 5e-1 good, count(*) n, round(avg(tech_score), 4) tech from f group by cube(event_type, aesthetic >= 5e-1)",
    "image_statistics": f"with {_F} select video_id, round(avg(aesthetic), 4) mean, round(stddev_pop(aesthetic), 4) std, round(var_pop(aesthetic), 4) var, round(max(aesthetic), 6) top, count(distinct tech_score) n_distinct, count(*) filter (where aesthetic < 1) dark from f group by video_id",
    "value_histogram": "select case when value < 0 then 0 when value >= 500 then 17 else floor(value / 3125e-2)::bigint + 1 end bin, count(*) n from events group by 1",
    "decision_lines": f"with s as ({SCORES_SQL}) select 'selected' || chr(9) || 'v' || image_id || chr(9) || 'frame=' || image_id || chr(9) || 'ts=' || printf('%.2f', image_id / 4e0) || chr(9) || 'clip=' || {_n.format('clip', 2, 'NA')} || chr(9) || 'nima=' || {_n.format('nima', 2, 'NA')} || chr(9) || 'piq=' || {_n.format('piq', 2, 'NA')} || chr(9) || 'overall=' || {_n.format('((clip + nima) * piq)', 2, 'NA')} || chr(9) || 'reason=NA' as value from s",
    "markdown_table": f"with s as ({SCORES_SQL}) select '| ' || image_id || '.jpg | ' || {_n.format('clip', 3, 'N/A')} || ' | ' || {_n.format('nima', 3, 'N/A')} || ' | ' || {_n.format('brisque', 3, 'N/A')} || ' |' as value from s",
    "selected_mapping": f"with s as ({SCORES_SQL}), k as (select image_id, coalesce(clip >= 5 and nima >= 5 and piq >= 8e-1 and (clip + nima) * piq >= 9, false) ok from s) select image_id, case when ok then 'out' else 'reject' end || row_number() over (partition by ok order by image_id) as name from k",
    "streamed_streaks": f"with {_F}, g as (select *, row_number() over (partition by video_id order by frame_index) - sum((aesthetic >= 5e-1)::int) over (partition by video_id order by frame_index rows unbounded preceding) isle from f), s as (select video_id, frame_index, row_number() over (partition by video_id, isle order by frame_index) k from g where aesthetic >= 5e-1) select video_id, frame_index from s where k >= 2",
    "streamed_dedup": f"""with recursive {_F}, o as materialized (select video_id, frame_index, timestamp_sec t, embedding v, row_number() over (partition by video_id order by timestamp_sec, frame_index) i from f),
 r(video_id, i, s, ids) as (select video_id, 0::bigint, []::struct(t double, v double[])[], []::int[] from (select distinct video_id from o) union all
 select o.video_id, o.i, case when b.dup then r.s else list_append(r.s, struct_pack(t := o.t, v := o.v)) end, case when b.dup then r.ids else list_append(r.ids, o.frame_index) end from r join o on o.video_id = r.video_id and o.i = r.i + 1,
 lateral (select len(list_filter(r.s, lambda x: o.t - x.t <= {5 * DAY}::double and list_dot_product(x.v, o.v) >= 4e-1)) > 0 dup) b) select video_id, unnest(ids) frame_index from (select *, row_number() over (partition by video_id order by i desc) z from r) where z = 1""",
    "streamed_best": f"with {_F}, t as (select f.*, e.ts from f join events e using (event_id)) select video_id, epoch_us(date_trunc('day', ts)) window_us, frame_index from (select *, row_number() over (partition by video_id, date_trunc('day', ts) order by aesthetic desc, frame_index) r from t) where r = 1",
    "streamed_sessions": f"""with {_F}, g as (select video_id, ts, aesthetic, ts - lag(ts) over (partition by video_id order by ts) > interval 6 hours brk from f join events e using (event_id) where aesthetic >= 5e-1), i as (select *, sum(coalesce(brk::int, 1)) over (partition by video_id order by ts rows unbounded preceding) isle from g)
 select video_id, epoch_us(min(ts)) start_us, count(*) hits, round(max(aesthetic), 6) best_sim from i group by video_id, isle""",
}
