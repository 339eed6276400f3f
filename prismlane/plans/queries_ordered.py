"""Windows, sampling, segments and ranks over frames of each video."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlane.operators import ordered as O
from prismlane.sources.tables import FRAMES_SQL, frames, load

GAP, HOUR, DAY = 21600.0, 3600.0, 86400.0


def _f(spark, d):
    return frames(spark, d, vectors=False)


def _hits(spark, d):
    return _f(spark, d).withColumn("matched", F.col("aesthetic") >= 0.5)


def best_per_window(spark, d):
    f = _f(spark, d).select("video_id", "timestamp_sec", "frame_index", "aesthetic")
    return O.best_per_window(f, "video_id", "timestamp_sec", "frame_index", "aesthetic", DAY).select("video_id", "window_id", "frame_index", F.round("aesthetic", 6).alias("aesthetic"))


def best_per_window_two_phase(spark, d):
    return O.best_two_phase(_f(spark, d), "video_id", "timestamp_sec", "frame_index", "tech_score", "aesthetic", DAY, 0.5)


def adaptive_stride(spark, d):
    return O.adaptive_stride(_f(spark, d), "video_id", "frame_index", "aesthetic", 0.5).select("video_id", "frame_index", F.round("motion", 6).alias("motion"))


def stride_sample(spark, d):
    return O.stride_sample(_f(spark, d), "frame_index", 3).select("video_id", "frame_index")


def sampling_steps(spark, d):
    fps = F.when(F.col("event_id") % 7 == 0, 0.0).otherwise((F.col("event_id") % 120) / F.lit(2.0))
    return load(spark, d, "events").select("event_id", O.sampling_step(fps, 2.0).alias("step"), O.stride_step(fps, 1.0).alias("stride"))


def _videos(spark, d):
    return _f(spark, d).groupBy("video_id").agg(F.max("timestamp_sec").alias("duration_sec"), F.count("*").alias("n_frames"))


def chunk_plan(spark, d):
    return O.chunk_plan(_videos(spark, d), "duration_sec", 7 * DAY, 25 * DAY).select("video_id", F.col("chunk_id").cast("long").alias("chunk_id"), "start_sec", F.round("end_sec", 3).alias("end_sec"))


def hit_streaks(spark, d):
    return O.hit_streaks(_hits(spark, d), "video_id", "frame_index", "matched", 2).select("video_id", "frame_index", F.col("streak").cast("long").alias("streak"))


def _segments(spark, d):
    return O.hits_to_segments(_hits(spark, d).where("matched"), "video_id", "timestamp_sec", "aesthetic", GAP, HOUR, 2 * HOUR, F.lit(29 * DAY))


def hits_to_segments(spark, d):
    return _segments(spark, d).select("video_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "hits", F.round("best_sim", 6).alias("best_sim"))


def build_segments(spark, d):
    s = O.build_segments(_hits(spark, d).where("matched"), "video_id", "timestamp_sec", HOUR, HOUR, GAP, 3 * HOUR, F.lit(29 * DAY))
    return s.select("video_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def merged_intervals(spark, d):
    iv = _f(spark, d).select("video_id", "timestamp_sec", (F.col("timestamp_sec") + F.col("tech_score") * 600).alias("e"))
    return O.merge_intervals(iv, "video_id", "timestamp_sec", "e", HOUR).select("video_id", F.round("timestamp_sec", 3).alias("start_sec"), F.round("e", 3).alias("end_sec"))


def presence_intervals(spark, d):
    f = _f(spark, d).select("video_id", (F.col("event_id") % 2000).alias("idx")).distinct()
    return O.presence_intervals(f, "video_id", "idx", 10.0, 60.0, 25.0).select("video_id", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


def segment_validation(spark, d):
    """Segments in which enough of the samples match; samples meet segments in day buckets, and those without a sample go."""
    s = _segments(spark, d).withColumn("b", F.explode(F.sequence(F.floor(F.col("start_sec") / DAY), F.floor(F.col("end_sec") / DAY))))
    h = _hits(spark, d).select("video_id", "timestamp_sec", "matched", F.floor(F.col("timestamp_sec") / DAY).alias("b"))
    j = s.join(h, ["video_id", "b"]).where("timestamp_sec between start_sec and end_sec")
    r = j.groupBy("video_id", "start_sec", "end_sec").agg((F.sum(F.col("matched").cast("int")) / F.greatest(F.lit(1), F.count("*"))).alias("ratio"))
    return r.where("ratio >= 0.6").select("video_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), F.round("ratio", 6).alias("ratio"))


def session_segments(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("hits"), F.max("value").alias("best"), F.min("ts").alias("first"))
    return s.select("user_id", F.unix_micros("first").alias("first_us"), "hits", "best")


def rank_and_name(spark, d):
    f = O.ranked(_f(spark, d).where("aesthetic >= 2"), ["video_id"], ["timestamp_sec", "frame_index"])
    return f.select("video_id", "frame_index", F.col("rank").cast("long").alias("rank"), F.format_string("out%d_t%.1f.jpg", "rank", F.floor(F.col("timestamp_sec")).cast("double")).alias("file"))


def keep_budget(spark, d):
    v = _videos(spark, d).select("video_id", O.keep_budget(F.col("duration_sec"), 5 * DAY, 20 * DAY).alias("budget"))
    r = O.ranked(_f(spark, d), ["video_id"], [F.desc("aesthetic"), F.desc("tech_score"), "frame_index"]).join(v, "video_id")
    return r.where(F.col("rank") <= F.col("budget")).select("video_id", "frame_index", F.col("budget").cast("long").alias("budget"))


def frame_cap(spark, d):
    return O.ranked(_f(spark, d).where("aesthetic >= 1"), ["video_id"], ["frame_index"]).where("rank <= 5").select("video_id", "frame_index")


def time_cap(spark, d):
    return _f(spark, d).where(F.col("timestamp_sec") < 10 * DAY).groupBy("video_id").agg(F.count("*").alias("n"))


def video_prominence(spark, d):
    f = _f(spark, d)
    big = f.where("frame_index <= 200").groupBy("video_id").agg(F.sum((F.col("tech_score") >= 60).cast("int")).alias("hits")).where("hits >= 5")
    return f.join(big, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("n"))


def clip_manifest(spark, d):
    from prismlane.sources.sinks import clip_manifest as make

    return make(_segments(spark, d), "video_id").select("video_id", "clip", "dir", F.round("start_sec", 3).alias("start_sec"), "hits")


def gate_expression(spark, d):
    """The gate over all segments of every video."""
    from prismlane.sources.sinks import gate_expression as make

    return make(hits_to_segments(spark, d), "video_id")


QUERIES = {f.__name__: f for f in (best_per_window, best_per_window_two_phase, adaptive_stride, stride_sample, sampling_steps, chunk_plan, hit_streaks, hits_to_segments, build_segments, merged_intervals, presence_intervals, segment_validation, session_segments, rank_and_name, keep_budget, frame_cap, time_cap, video_prominence, clip_manifest, gate_expression)}

_F = f"f as ({FRAMES_SQL})"
_SEG = f"""{_F}, g as (select *, timestamp_sec - lag(timestamp_sec) over (partition by video_id order by timestamp_sec) > {GAP}::double brk from f where aesthetic >= 5e-1),
 i as (select *, sum(coalesce(brk::int, 1)) over (partition by video_id order by timestamp_sec rows unbounded preceding) isle from g),
 s as (select video_id, greatest(0e0, min(timestamp_sec) - {HOUR}::double) start_sec, least({29 * DAY}::double, max(timestamp_sec) + {2 * HOUR}::double) end_sec, count(*) hits, max(aesthetic) best_sim from i group by video_id, isle)"""


def _merge(src: str, gap: str) -> str:
    return f"""select video_id, min(s) s, max(e) e from (select *, sum(coalesce((s > far + {gap})::int, 1)) over (partition by video_id order by s, e rows unbounded preceding) isle from
 (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) far from {src})) group by video_id, isle"""


SQL = {
    "best_per_window": f"with {_F} select video_id, window_id, frame_index, round(aesthetic, 6) aesthetic from (select *, floor(timestamp_sec / {DAY}::double)::bigint window_id, row_number() over (partition by video_id, floor(timestamp_sec / {DAY}::double) order by aesthetic desc, frame_index) r from f) where r = 1",
    "best_per_window_two_phase": f"""with {_F}, r as (select *, floor(timestamp_sec / {DAY}::double)::bigint window_id, row_number() over (partition by video_id, floor(timestamp_sec / {DAY}::double) order by tech_score desc, frame_index) rk from f),
 w as (select video_id, window_id, count(*) n, max(case when rk = 1 then aesthetic end) fa, max(case when rk = 1 then frame_index end) fi, arg_max(frame_index, (aesthetic, -rk)) ei from r group by video_id, window_id)
 select video_id, window_id, case when n > 1 and fa < 1e0 then ei else fi end frame_index, n > 1 and fa < 1e0 revisited from w""",
    "adaptive_stride": f"with {_F}, m as (select video_id, frame_index, abs(aesthetic - lag(aesthetic) over (partition by video_id order by frame_index)) motion from f) select video_id, frame_index, round(motion, 6) motion from m where motion is null or motion >= 5e-1",
    "stride_sample": f"with {_F} select video_id, frame_index from f where frame_index % 3 = 0",
    "sampling_steps": "with e as (select event_id, case when event_id % 7 = 0 or event_id % 120 = 0 then 25e0 else (event_id % 120) / 2e0 end fps from events) select event_id, greatest(1, round_even(fps / 2e0, 0)::int) step, greatest(1, round_even(fps, 0)::int) stride from e",
    "chunk_plan": f"""with {_F}, v as (select video_id, least(max(timestamp_sec), {25 * DAY}::double) d from f group by video_id), c as (select *, unnest(range(0, greatest(1, ceil(d / {7 * DAY}::double)::bigint))) chunk_id from v)
 select video_id, chunk_id, chunk_id * {7 * DAY}::double start_sec, round(least(chunk_id * {7 * DAY}::double + {7 * DAY}::double, d), 3) end_sec from c""",
    "hit_streaks": f"""with {_F}, g as (select *, row_number() over (partition by video_id order by frame_index) - sum((aesthetic >= 5e-1)::int) over (partition by video_id order by frame_index rows unbounded preceding) isle from f),
 s as (select video_id, frame_index, row_number() over (partition by video_id, isle order by frame_index) streak from g where aesthetic >= 5e-1) select * from s where streak >= 2""",
    "hits_to_segments": f"with {_SEG} select video_id, round(start_sec, 3) start_sec, round(end_sec, 3) end_sec, hits, round(best_sim, 6) best_sim from s where end_sec > start_sec",
    "build_segments": f"""with {_F}, p as (select video_id, timestamp_sec t, greatest(0e0, timestamp_sec - {HOUR}::double) s, least({29 * DAY}::double, timestamp_sec + {HOUR}::double) e from f where aesthetic >= 5e-1),
 q as (select video_id, s, e, greatest(0e0, t - {1.5 * HOUR}::double) s2, t from p), x as (select video_id, case when e - s >= {3 * HOUR}::double then s when s2 + {3 * HOUR}::double > {29 * DAY}::double then greatest(0e0, {29 * DAY}::double - {3 * HOUR}::double) else s2 end s,
 case when e - s >= {3 * HOUR}::double then e when s2 + {3 * HOUR}::double > {29 * DAY}::double then {29 * DAY}::double else s2 + {3 * HOUR}::double end e from q), m as ({_merge("x", f"{GAP}::double")}) select video_id, round(s, 3) start_sec, round(e, 3) end_sec from m where e > s + 5e-2""",
    "merged_intervals": f"with {_F}, x as (select video_id, timestamp_sec s, timestamp_sec + tech_score * 600 e from f), m as ({_merge('x', f'{HOUR}::double')}) select video_id, round(s, 3) start_sec, round(e, 3) end_sec from m",
    "presence_intervals": f"""with {_F}, t as (select distinct video_id, event_id % 2000 idx from f), u as (select video_id, greatest(0e0, least(50e0, idx / 25e0 - 10e0)) t from t where idx >= 250 and idx < 1500),
 p as (select video_id, t, greatest(0e0, t - 15e-2) s, least(50e0, t + 15e-2) e from u), x as (select video_id, min(s) s, max(e) e from (select *, sum(coalesce((t - far > 2e-1)::int, 1)) over (partition by video_id order by t rows unbounded preceding) isle from (select *, max(e) over (partition by video_id order by t rows between unbounded preceding and 1 preceding) far from p)) group by video_id, isle having max(e) > min(s)),
 m as ({_merge("x", "2e-1")}) select video_id, round(s, 4) start_sec, round(e, 4) end_sec from m""",
    "segment_validation": f"""with {_SEG} select s.video_id, round(s.start_sec, 3) start_sec, round(s.end_sec, 3) end_sec, round(avg((f.aesthetic >= 5e-1)::int), 6) ratio from s join f on f.video_id = s.video_id and f.timestamp_sec between s.start_sec and s.end_sec
 where s.end_sec > s.start_sec group by s.video_id, s.start_sec, s.end_sec having avg((f.aesthetic >= 5e-1)::int) >= 6e-1""",
    "session_segments": """with g as (select user_id, ts, value, ts - lag(ts) over (partition by user_id order by ts) > interval 6 hours brk from events), i as (select *, sum(coalesce(brk::int, 1)) over (partition by user_id order by ts rows unbounded preceding) isle from g)
 select user_id, epoch_us(min(ts)) first_us, count(*) hits, max(value) best from i group by user_id, isle""",
    "rank_and_name": f"with {_F}, r as (select *, row_number() over (partition by video_id order by timestamp_sec, frame_index) rk from f where aesthetic >= 2) select video_id, frame_index, rk as rank, 'out' || rk || '_t' || printf('%.1f', floor(timestamp_sec)) || '.jpg' file from r",
    "keep_budget": f"""with {_F}, v as (select video_id, greatest(1, floor(least(max(timestamp_sec), {20 * DAY}::double) / {5 * DAY}::double)::bigint) budget from f group by video_id), r as (select *, row_number() over (partition by video_id order by aesthetic desc, tech_score desc, frame_index) rk from f)
 select r.video_id, frame_index, budget from r join v using (video_id) where rk <= budget""",
    "frame_cap": f"with {_F} select video_id, frame_index from (select *, row_number() over (partition by video_id order by frame_index) rk from f where aesthetic >= 1) where rk <= 5",
    "time_cap": f"with {_F} select video_id, count(*) n from f where timestamp_sec < {10 * DAY}::double group by video_id",
    "video_prominence": f"with {_F} select video_id, count(*) n from f group by video_id having sum(case when frame_index <= 200 and tech_score >= 60 then 1 else 0 end) >= 5",
    "clip_manifest": f"with {_SEG} select video_id, 'clip_' || printf('%03d', row_number() over (partition by video_id order by start_sec, end_sec) - 1) || '.mp4' clip, 'clips/' || video_id dir, round(start_sec, 3) start_sec, hits from s where end_sec > start_sec and end_sec - start_sec > 5e-2",
    "gate_expression": f"""with {_SEG}, x as (select video_id, round(start_sec, 3) s, round(end_sec, 3) e from s where end_sec > start_sec)
 select video_id, string_agg('between(t,' || printf('%.3f', s) || ',' || printf('%.3f', e) || ')', '+' order by s, e) gate from x group by video_id""",
}
