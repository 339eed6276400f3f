"""Pipelines, the first cascade, sizes, schedules, draw instructions and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlane.config import ClusterConfig, ImageConfig, KeyframeConfig, PersonConfig, SpeakerConfig, TwoPassConfig
from prismlane.functions import geometry as G
from prismlane.functions import naming as N
from prismlane.functions import scores as S
from prismlane.functions import vectors as V
from prismlane.operators import ordered as O
from prismlane.plans import pipeline_sql
from prismlane.plans import pipelines as P
from prismlane.plans.queries_scores import _tech
from prismlane.sources import files
from prismlane.sources.tables import BOXES_SQL, FRAMES_SQL, PIXELS_SQL, SCORES_SQL, boxes, frames, image_scores, load, pixels

DAY = 86400.0


def capped_size(spark, d):
    c = S.capped_size(F.col("width"), F.col("height"), 720)
    return pixels(spark, d).select("event_id", *[(F.round(v, 4) if k in ("scale", "min_edge", "min_pixels") else v.cast("long")).alias(k) for k, v in c.items()])


def detail_names(spark, d):
    p = pixels(spark, d)
    return p.select("event_id", N.detail_slug(F.initcap("event_type"), {"threshold": F.lit(60), "k": F.col("event_id") % 7}).alias("name"), N.in_root(F.concat(F.lit("/a/b/v"), F.col("video_id"), F.lit(".mp4")), F.lit("out1.jpg")).alias("root_name"))


def _original_columns():
    c = {
        "outdoor": S.outdoors(F.col("skin"), F.col("person_ratio") * 2), "scenic": F.col("max_luma") > 0.5, "sharpness_var": F.col("sharpness_var"), "aesthetic": F.col("aesthetic"), "plain_aesthetic": F.col("aesthetic") - 0.1, "text_prominent": F.col("text_prominent"),
        "person_areas": F.when(F.col("k") > 1, F.array(F.col("person_ratio"), F.col("person_ratio") * 2)).otherwise(F.expr("cast(array() as array<double>)")),
        "face_areas": F.when(F.col("k") > 2, F.array(F.col("face_rel_area") / 4)).otherwise(F.expr("cast(array() as array<double>)")),
        "roi_sharpness": F.when(F.col("k") > 2, F.array(F.col("face_sharpness"))).otherwise(F.expr("cast(array() as array<double>)")),
    }
    return c


def original_gates(spark, d):
    p = pixels(spark, d).withColumn("k", F.col("event_id") % 5)
    return p.select("event_id", F.coalesce(S.original_gate(_original_columns(), min_aesthetic=0.3), F.lit("kept")).alias("reason"))


def area_ratios(spark, d):
    """The sum, capped at 1, and the largest of the boxes' shares of a frame, and the boxes per frame."""
    whole, area = F.lit(640.0 * 480.0), F.col("w") * F.col("h")
    return boxes(spark, d).groupBy("video_id", "frame_idx").agg(F.round(F.least(F.lit(1.0), F.sum(area) / whole), 6).alias("total"), F.round(F.max(area) / whole, 6).alias("largest"), F.count("*").alias("n"))


def largest_faces(spark, d):
    b = O.largest_boxes(boxes(spark, d), ["video_id", "frame_idx"], "w", "h", 2, "event_id")
    return b.select("video_id", "frame_idx", "event_id", F.col("rank").cast("long").alias("rank"))


def best_face(spark, d):
    """One face a frame: a hit before none, then the higher key."""
    p = pixels(spark, d).withColumn("frame", F.col("event_id") % 40).withColumn("hit", F.col("face_conf") >= 0.6)
    return p.groupBy("video_id", "frame").agg(F.max_by("event_id", F.struct("hit", "face_rel_area", -F.col("event_id"))).alias("event_id"))


def detect_schedule(spark, d):
    f = frames(spark, d, vectors=False).withColumn("live", F.col("event_type") != "error")
    return O.detect_schedule(f, "video_id", "frame_index", 5, "live").select("video_id", "frame_index", "detect")


def seek_sample(spark, d):
    v = frames(spark, d, vectors=False).groupBy("video_id").agg((F.count("*") * 40).cast("int").alias("frames")).withColumn("fps", F.lit(12.5) + F.col("video_id") % 3)
    return O.seek_sample(v, "video_id", "frames", "fps", 2.0, 1.5, 100.0).select("video_id", "frame_index", F.round("timestamp_sec", 6).alias("timestamp_sec"))


def face_gate(spark, d):
    e = load(spark, d, "embeddings")
    p = pixels(spark, d).join(e.select((F.col("vec_id")).alias("event_id"), "embedding"), "event_id")
    return p.where((F.col("face_rel_area") >= 0.02) & (F.col("face_sharpness") >= 60) & V.finite(F.col("embedding"), 64)).select("event_id")


def draw_instructions(spark, d):
    """Per frame the target's padded box, or the nearest one within a window, and the other boxes to grey out."""
    b = boxes(spark, d)
    t = b.groupBy("video_id", "frame_idx").agg(F.min_by(F.struct("x", "y", "w", "h"), "event_id").alias("t"), F.min("event_id").alias("event_id"))
    j = b.join(t.withColumnRenamed("event_id", "target"), ["video_id", "frame_idx"])
    i = G.iou(*[F.col(f"t.{c}") for c in "xywh"], *map(F.col, "xywh"))
    pad = G.padded_even(*[F.col(f"t.{c}") for c in "xywh"], 640, 480)
    out = j.groupBy("video_id", "frame_idx", "t").agg(F.array_sort(F.collect_list(F.when((F.col("event_id") != F.col("target")) & (i < 0.3), F.col("event_id")))).alias("grey"))
    return out.select("video_id", "frame_idx", *[v.cast("long").alias(k) for k, v in pad.items()], F.array_join(F.transform("grey", lambda x: x.cast("string")), ",").alias("grey"))


def input_listing(spark, d):
    """The Parquet tables of the input folder by name."""
    found = files.listing(spark, d, ("parquet",)).select(F.regexp_extract("path", r"/([a-z_]+)\.parquet", 1).alias("name"))
    return found.where("name <> ''").distinct()


def frame_features(spark, d):
    """The frames that the pipelines read, with vectors."""
    e = load(spark, d, "embeddings")
    n = e.agg(F.count("*")).scalar()
    p = pixels(spark, d).withColumn("tech", _tech()).withColumn("tilt", G.tilt(F.col("eye_dy"), F.col("eye_dx"))).withColumn("vec_id", F.col("event_id") % n)
    f = frames(spark, d, vectors=False).select("event_id", "frame_index", "timestamp_sec", "has_smile")
    return p.join(f, "event_id").join(e.select("vec_id", "embedding"), "vec_id")


def _cfg() -> KeyframeConfig:
    return KeyframeConfig(min_tech=25.0, dedup=0.75, chunk_sec=7 * DAY, max_frames=6)


def _easy(f):
    return f.withColumn("aesthetic", F.col("aesthetic") + 5).withColumn("piq", F.col("piq") / 4 + 0.72).withColumn("mean_luma", F.col("mean_luma") / 2 + 0.3).withColumn("face_sharpness", F.col("face_sharpness") + 50)


def keyframes_pipeline(spark, d):
    selected, _ = P.keyframes(_easy(frame_features(spark, d)), _cfg())
    return selected


def keyframes_decisions(spark, d):
    _, decisions = P.keyframes(_easy(frame_features(spark, d)), _cfg())
    return decisions.groupBy("status", "reason").agg(F.count("*").alias("n"))


def two_pass_frames(spark, d):
    """Frames with the columns of the first cascade and vectors; the stored image's sharpness is the frame's, shifted."""
    p = pixels(spark, d).withColumn("k", F.col("event_id") % 5)
    names = _original_columns()
    f = frames(spark, d).select("event_id", "frame_index", "timestamp_sec", F.col("embedding").cast("array<double>").alias("embedding"))
    p = p.select("event_id", "video_id", *[v.alias(k) for k, v in names.items()], F.expr("cast(array() as array<double>)").alias("final_roi_sharpness"), ((F.col("event_id") % 10) * 20.0).alias("final_sharpness"))
    return p.join(f, "event_id")


def two_pass_pipeline(spark, d):
    """The first program as a whole: cascade, suppression within the budget, prune."""
    _, decisions = P.two_pass_keyframes(two_pass_frames(spark, d), TwoPassConfig(sec_per_image=3 * DAY, dedup=0.7, min_aesthetic=0.3))
    return decisions.select("video_id", "frame_index", "is_representative", "reason")


def speaker_pipeline(spark, d):
    """Segments of each video's clicks, who speaks in them (other events stand for turns), and the gates."""
    f = frames(spark, d, vectors=False)
    clips = O.merge_intervals(f.where("has_smile").select("video_id", F.col("timestamp_sec").alias("start_sec"), (F.col("timestamp_sec") + 40000).alias("end_sec")), "video_id", "start_sec", "end_sec", 0.0)
    clips = clips.withColumn("clip_id", F.concat_ws(":", "video_id", F.floor("start_sec")))
    seen = clips.join(f.where("has_smile").select("video_id", F.col("timestamp_sec").alias("t")), "video_id").where("t >= start_sec and t < end_sec").select("clip_id", "t")
    turns = f.where("not has_smile").select("video_id", F.col("event_type").alias("speaker"), F.col("timestamp_sec").alias("start_sec"), (F.col("timestamp_sec") + F.col("tech_score") * 600).alias("end_sec"))
    out = P.speaker_clips(clips, seen, turns, SpeakerConfig(presence_pad=9000.0, min_turn=60.0, turn_gap=1.0, near=10.0))
    return out.select("clip_id", "speaker", F.round("score", 2).alias("score"))


def _detections(spark, d):
    f = frames(spark, d)
    return f.select("video_id", F.col("event_id").alias("face_id"), F.col("timestamp_sec").alias("t"), "frame_index", ((F.col("event_id") % 47) / 100.0).alias("area_ratio"), (F.col("event_id") % 120).cast("double").alias("sharpness"), V.sign_hash(F.col("embedding")).alias("face_hash"), "embedding")


def face_clusters_pipeline(spark, d):
    clusters, _ = P.face_clusters(_detections(spark, d), ClusterConfig(min_sharpness=20.0, similarity=0.2, min_size=2))
    return clusters


def face_segments_pipeline(spark, d):
    _, segments = P.face_clusters(_detections(spark, d), ClusterConfig(min_sharpness=20.0, similarity=0.2, min_size=2, merge_gap=DAY, min_dur=3600.0))
    return segments


def person_clips_pipeline(spark, d):
    faces = _detections(spark, d)
    photos = [list(map(float, r["embedding"])) for r in load(spark, d, "embeddings").where("vec_id < 2").orderBy("vec_id").collect()]
    samples = faces.select("video_id", "frame_index", F.col("t").alias("timestamp_sec"), F.lit(30 * DAY).alias("duration_sec"))
    clips = P.person_clips(faces, samples, photos, PersonConfig(match=0.05, consecutive=1, every_photo=False, join_gap=DAY, pre=600.0, post=600.0, min_sharpness=20.0, least_ratio=0.3))
    return clips.withColumn("best_sim", F.round("best_sim", 6))


def score_images_pipeline(spark, d):
    s = image_scores(spark, d).withColumn("image", F.concat(F.lpad(F.col("image_id").cast("string"), 9, "0"), F.lit(".JPG")))
    return P.score_images(s, ImageConfig("ordered")).select("image", F.round("overall_rating", 6).alias("overall_rating"), "selected", "file", "slug")


QUERIES = {f.__name__: f for f in (capped_size, detail_names, original_gates, area_ratios, largest_faces, best_face, detect_schedule, seek_sample, face_gate, draw_instructions, input_listing, keyframes_pipeline, keyframes_decisions, face_clusters_pipeline, face_segments_pipeline, person_clips_pipeline, score_images_pipeline, two_pass_pipeline, speaker_pipeline)}
_F = f"f as materialized ({FRAMES_SQL})"
_pad = lambda a, b: f"trunc({a} - {b} * 2e-1)::bigint"
SQL = {
    "capped_size": f"with p as ({PIXELS_SQL}), s as (select *, case when greatest(width, height) > 720 then 720 / greatest(width, height)::double else 1e0 end s from p) select event_id, round(s, 4) scale, greatest(1, round_even(width * s, 0)::bigint) new_w, greatest(1, round_even(height * s, 0)::bigint) new_h, round(greatest(1e0, 320 * s), 4) min_edge, round(greatest(10e0, 200000 * s * s), 4) min_pixels from s",
    "detail_names": f"with p as ({PIXELS_SQL}) select event_id, event_type || '__k-' || (event_id % 7) || '__threshold-60' as name, 'v' || video_id || '__out1.jpg' root_name from p",
    "original_gates": f"""with p as ({PIXELS_SQL}), t as (select *, event_id % 5 k, skin > 6e-2 or person_ratio * 2 > 12e-2 od from p) select event_id, case when not od and k <= 1 then 'no_person' when not od and person_ratio * 2 < 5e-2 then 'person_small'
 when not od and k <= 2 then 'indoor_no_face' when not od and face_rel_area / 4 < 2e-2 then 'face_small' when k <= 1 and not max_luma > 5e-1 then 'no_scene_no_person' when text_prominent then 'text'
 when not (sharpness_var >= 50 or (k > 2 and face_sharpness >= 50)) and not (od and max_luma > 5e-1 and aesthetic - 1e-1 >= 3e-1) then 'blur' when aesthetic < 3e-1 then 'low_aesthetic' else 'kept' end reason from t""",
    "area_ratios": f"with b as ({BOXES_SQL}) select video_id, frame_idx, round(least(1e0, sum(w * h) / 307200e0), 6) total, round(max(w * h) / 307200e0, 6) largest, count(*) n from b group by video_id, frame_idx",
    "largest_faces": f"with b as ({BOXES_SQL}) select video_id, frame_idx, event_id, r as rank from (select *, row_number() over (partition by video_id, frame_idx order by w * h desc, event_id) r from b) where r <= 2",
    "best_face": f"with p as ({PIXELS_SQL}) select video_id, event_id % 40 frame, event_id from (select *, row_number() over (partition by video_id, event_id % 40 order by face_conf >= 6e-1 desc, face_rel_area desc, event_id) r from p) where r = 1",
    "detect_schedule": f"with {_F} select video_id, frame_index, (row_number() over (partition by video_id order by frame_index) - 1) % 5 = 0 or event_type = 'error' detect from f",
    "seek_sample": f"""with {_F}, v as (select video_id, count(*) * 40 n, 125e-1 + video_id % 3 fps from f group by video_id), s as (select *, greatest(1, round_even(fps * 15e-1, 0)::bigint) st, least(n, round_even(fps * 2, 0)::bigint) a from v), i as (select video_id, fps, unnest(range(a, n, st)) frame_index from s)
 select video_id, frame_index, round(frame_index / fps, 6) timestamp_sec from i where frame_index / fps < 100""",
    "face_gate": f"with p as ({PIXELS_SQL}) select p.event_id from p join embeddings e on e.vec_id = p.event_id where face_rel_area >= 2e-2 and face_sharpness >= 60 and len(embedding) = 64",
    "draw_instructions": f"""with b as ({BOXES_SQL}), t as (select * from (select *, row_number() over (partition by video_id, frame_idx order by event_id) r from b) where r = 1), j as (select t.*, b.event_id other, greatest(0, least(t.x + t.w, b.x + b.w) - greatest(t.x, b.x)) * greatest(0, least(t.y + t.h, b.y + b.h) - greatest(t.y, b.y)) i, t.w * t.h + b.w * b.h u from t join b using (video_id, frame_idx)),
 g as (select video_id, frame_idx, greatest(0, {_pad("x", "w")}) px, greatest(0, {_pad("y", "h")}) py, least(640, trunc(x + w * 12e-1)::bigint) x1, least(480, trunc(y + h * 12e-1)::bigint) y1, coalesce(string_agg(case when other <> event_id and i::double / (u - i::double + 1e-9) < 3e-1 then other::varchar end, ',' order by other), '') grey from j group by all)
 select video_id, frame_idx, px, py, (x1 - px) - (x1 - px) % 2 pw, (y1 - py) - (y1 - py) % 2 ph, grey from g""",
    "score_images_pipeline": f"""with s as ({SCORES_SQL}), k as (select printf('%09d', image_id) || '.JPG' image, (clip + nima) * piq o, coalesce(case when (clip + nima) * piq <= 55e-1 then false when clip >= 6 or nima >= 55e-1 or clip + nima >= 105e-1 or piq >= 85e-2 or (clip + nima) * piq >= 8 then true
 when clip is null or nima is null or piq is null then false else clip >= 5 and nima >= 5 and piq >= 65e-2 and coalesce(brisque <= 40, false) end, false) selected from s)
 select image, round(o, 6) overall_rating, selected, case when selected then 'out' else 'reject' end || row_number() over (partition by selected order by image) || '.JPG' file, replace(lower(image), '.', '_') slug from k""",
}
SQL |= pipeline_sql.SQL
