"""The end-to-end pipelines, each a composition of operators over tables of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlane.config import ClusterConfig, ImageConfig, KeyframeConfig, PersonConfig, SpeakerConfig, TwoPassConfig
from prismlane.functions import naming as N
from prismlane.functions import scores as S
from prismlane.functions import vectors as V
from prismlane.operators import folds as D
from prismlane.operators import joins as J
from prismlane.operators import ordered as O
from prismlane.shared import stash
from prismlane.sources import sinks as K


def keyframes(frames: DataFrame, cfg: KeyframeConfig = KeyframeConfig()) -> tuple[DataFrame, DataFrame]:
    """(selected, decisions) from sampled frames with features, scores and vectors.

    frames: video_id, frame_index, timestamp_sec, embedding, has_smile, the columns of scores.decision with `tech` and `tilt`.
    Cheap tests come first in one expression, then per chunk and per video the two folds; every frame gets one decision.
    """
    f = frames if cfg.max_seconds is None else frames.where(F.col("timestamp_sec") < cfg.max_seconds)
    if cfg.adaptive_least is not None:
        f = f.where(F.col("motion").isNull() | (F.col("motion") >= cfg.adaptive_least))
    reason = S.decision({c: F.col(c) for c in f.columns}, cfg.require_face, cfg.allow_faceless, cfg.scenic_only, cfg.min_face_area, cfg.min_face_y, cfg.min_aesthetic, cfg.min_tech)
    rated = S.overall(F.col("aesthetic"), F.col("nima"), F.col("piq"))
    f = f.withColumn("reason", reason).withColumn("overall", rated).withColumn("chunk_id", F.floor(F.col("timestamp_sec") / cfg.chunk_sec))
    f = f.withColumn("quality", F.coalesce("overall", "aesthetic"))
    good = f.where("reason = 'kept'").withColumn("group_id", F.concat_ws(":", "video_id", "chunk_id"))
    if cfg.max_frames:
        good = O.ranked(good, ["group_id"], ["frame_index"], "cap_").where(F.col("cap_") <= cfg.max_frames)
    order = [("aesthetic", False), ("frame_index", True)]
    first = D.dedup_with_replacement(good, "group_id", "embedding", order, "has_smile", "quality", cfg.dedup, "frame_index").withColumnRenamed("status", "first")
    good = good.join(first, ["group_id", "frame_index"])
    limit = cfg.dedup if cfg.final_dedup is None else cfg.final_dedup
    last = D.final_dedup(good.where("first = 'kept'"), "video_id", "chunk_id", "embedding", order, "has_smile", "quality", limit, "frame_index", cfg.ghosts)
    marks = good.select("video_id", "frame_index", "first").join(last, ["video_id", "frame_index"], "left")
    out = f.join(marks, ["video_id", "frame_index"], "left")
    why = F.when(F.col("reason") != "kept", F.col("reason")).when(F.col("first").isNull(), "max_frames").when(F.col("first") != "kept", F.col("first")).when(~F.col("kept"), "final_dedup")
    decisions = out.withColumn("reason", why).withColumn("status", F.when(F.col("reason").isNull(), "selected").otherwise("rejected"))
    keep = ["video_id", "frame_index", "timestamp_sec", "aesthetic", "nima", "piq", "overall"]
    decisions = stash(decisions.select(*keep, "status", "reason"), "decisions")  # both outputs read it; the folds run once
    selected = O.ranked(decisions.where("status = 'selected'"), ["video_id"], ["timestamp_sec", "frame_index"])
    name = F.format_string("out%d_t%s_clip-%s.jpg", "rank", S.text_number(F.col("timestamp_sec")), S.text_number(F.col("aesthetic")))
    return selected.select(*keep, "rank", name.alias("file")), decisions


def two_pass_keyframes(frames: DataFrame, cfg: TwoPassConfig = TwoPassConfig()) -> tuple[DataFrame, DataFrame]:
    """(selected, decisions): the first cascade, then the best frames of a video with near ones suppressed, as many as its length
    allows, then once more the sharpness test.

    frames: video_id, frame_index, timestamp_sec, embedding, final_roi_sharpness and final_sharpness (of the image as stored), the
    columns of scores.original_gate.
    """
    f = frames if cfg.max_seconds is None else frames.where(F.col("timestamp_sec") < cfg.max_seconds)
    gate = S.original_gate({c: F.col(c) for c in f.columns}, cfg.person_filter, cfg.face_filter, cfg.indoor_needs_face, cfg.allow_scenery, cfg.scene_or_person, cfg.min_person, cfg.min_face, cfg.min_sharpness, cfg.min_aesthetic)
    f = f.withColumn("gate_", gate)
    budget = frames.groupBy("video_id").agg(O.keep_budget(F.max("timestamp_sec"), cfg.sec_per_image, cfg.max_seconds).alias("budget"))
    order = [("aesthetic", False), ("frame_index", True)]
    kept = D.greedy_dedup(f.where("gate_ is null").join(budget, "video_id"), "video_id", "embedding", order, cfg.dedup, "frame_index", "budget")
    out = f.join(kept.withColumn("kept_", F.lit(True)), ["video_id", "frame_index"], "left")
    sharp = S.sharp_enough(F.col("final_roi_sharpness"), F.col("final_sharpness"), cfg.min_sharpness)
    why = F.when(F.col("gate_").isNotNull(), F.col("gate_")).when(F.col("kept_").isNull(), "dedup_or_budget").when(~sharp, "blur_after_dedup")
    decisions = out.withColumn("reason", why).withColumn("is_representative", F.col("reason").isNull())
    keep = ["video_id", "frame_index", "timestamp_sec", "aesthetic"]
    decisions = stash(decisions.select(*keep, "is_representative", "reason"), "decisions")
    selected = O.ranked(decisions.where("is_representative"), ["video_id"], ["timestamp_sec", "frame_index"])
    return selected.select(*keep, "rank", N.frame_file(F.col("frame_index"), F.col("timestamp_sec")).alias("file")), decisions


def speaker_clips(segments: DataFrame, seen: DataFrame, turns: DataFrame, cfg: SpeakerConfig = SpeakerConfig()) -> DataFrame:
    """Each segment with the speaker who talks most while its person is there (who talks most, where nobody is seen), and the
    audio gate over that speaker's turns; null speaker and gate where nobody speaks.

    segments: clip_id, video_id, start_sec, end_sec; seen: clip_id, t (times at which the person is detected); turns: video_id,
    speaker, start_sec, end_sec. All times are of the video; the gate's are of the clip.
    """
    span = segments.select("clip_id", "video_id", F.col("start_sec").alias("a_"), F.col("end_sec").alias("b_"))
    pad = F.lit(cfg.presence_pad)
    there = seen.join(span, "clip_id").where("t >= a_ and t < b_").select("clip_id", F.greatest(F.lit(0.0), F.col("t") - F.col("a_") - pad).alias("s"), F.least(F.col("b_") - F.col("a_"), F.col("t") - F.col("a_") + pad).alias("e"))
    there = O.merge_intervals(there, "clip_id", "s", "e", cfg.near)
    # turns reach segments in the hour buckets that both touch
    mine = J.overlaps(span.select("clip_id", "video_id", F.col("a_").alias("s"), F.col("b_").alias("e")), turns.select("video_id", "speaker", F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2")), "video_id", 3600.0)
    mine = mine.select(F.to_json(F.struct("clip_id", "speaker")).alias("who"), "clip_id", "speaker", (F.greatest("s", "s2") - F.col("s")).alias("start_sec"), (F.least("e", "e2") - F.col("s")).alias("end_sec"))
    names = mine.select("who", "clip_id", "speaker").distinct()
    mine = O.merge_intervals(mine.select("who", "start_sec", "end_sec"), "who", "start_sec", "end_sec", cfg.turn_gap).where(F.col("end_sec") - F.col("start_sec") >= cfg.min_turn).join(names, "who")
    both = J.overlaps(there, mine.select("clip_id", "speaker", F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2")), "clip_id", 3600.0)
    both = both.groupBy("clip_id", "speaker").agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("shared"))
    talk = mine.groupBy("clip_id", "speaker").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("talk"))
    anyone = there.select("clip_id").distinct().withColumn("seen_", F.lit(True))
    score = F.when(F.col("seen_"), F.coalesce("shared", F.lit(0.0))).otherwise(F.col("talk"))
    best = talk.join(both, ["clip_id", "speaker"], "left").join(anyone, "clip_id", "left").groupBy("clip_id").agg(F.min_by(F.struct("speaker", score.alias("score")), F.struct(-F.round(score, 6), "speaker")).alias("b"))
    best = best.select("clip_id", "b.speaker", "b.score")
    gate = K.gate_expression(mine.join(best, ["clip_id", "speaker"], "left_semi").select("clip_id", "start_sec", "end_sec"), "clip_id")
    return segments.join(best, "clip_id", "left").join(gate, "clip_id", "left")


def face_clusters(faces: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> tuple[DataFrame, DataFrame]:
    """(clusters, segments) from detections: video_id, face_id, t, area_ratio, sharpness, face_hash, embedding, duration_sec.

    Clusters of the whole corpus (per_video=False) are one sequence, as the rule asks: each face meets the centroids so far. Only
    faces that pass the filters and the window of their video enter it, in one task.
    """
    good = faces.where((F.col("area_ratio") >= cfg.min_area) & (F.col("sharpness") >= cfg.min_sharpness) & V.finite(F.col("embedding")))
    kept = D.windowed_dedup(good, "video_id", "t", "face_hash", "embedding", "face_id", cfg.dedup_window, cfg.dedup_bits, cfg.dedup_least, cfg.dedup_method)
    good = good.join(kept, ["video_id", "face_id"], "left_semi").withColumn("scope", F.col("video_id").cast("string") if cfg.per_video else F.lit("all"))
    labels = D.clustered(good, "scope", "embedding", [("video_id", True), ("t", True), ("face_id", True)], cfg.similarity, "face_id")
    good = good.join(labels, ["scope", "face_id"])
    size = good.groupBy("scope", "cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= cfg.min_size)
    good = good.join(size, ["scope", "cluster_id"])
    mean = V.vector_mean(good, ["scope", "cluster_id"], "embedding").withColumn("centroid", V.normalised(F.col("centroid")))
    near = good.join(mean, ["scope", "cluster_id"]).withColumn("sim", V.dot(F.col("embedding"), F.col("centroid")))
    best = near.groupBy("scope", "cluster_id", "size").agg(F.max_by("face_id", F.struct(F.round("sim", 9), -F.col("t"))).alias("representative"))
    clusters = O.ranked(best, ["scope"], [F.desc("size"), "cluster_id"]).withColumn("name", F.format_string("face%d", "rank"))
    times = good.withColumn("key", F.concat_ws(":", "scope", "cluster_id", "video_id"))
    segments = O.build_segments(times.select("key", "t"), "key", "t", cfg.pre, cfg.post, cfg.merge_gap, cfg.min_dur)
    return clusters, K.clip_manifest(segments, "key")


def person_clips(faces: DataFrame, samples: DataFrame, queries: list[list[float]], cfg: PersonConfig = PersonConfig()) -> DataFrame:
    """Clips in which the person of the query vectors appears.

    faces: video_id, frame_index, area_ratio, sharpness, embedding; samples: video_id, frame_index, timestamp_sec, duration_sec.
    """
    mean = [sum(q[k] for q in queries) / len(queries) for k in range(len(queries[0]))]
    size = sum(x * x for x in mean) ** 0.5 + 1e-9
    good = faces.where((F.col("area_ratio") >= cfg.min_area) & (F.col("sharpness") >= cfg.min_sharpness))
    m = J.match_queries(good, queries, [x / size for x in mean], "embedding", cfg.match, cfg.margin, cfg.every_photo)
    value = F.col("smin") if cfg.every_photo else F.col("smax")
    best = m.groupBy("video_id", "frame_index").agg(F.max(F.struct("hit", value.alias("sim"))).alias("b")).select("video_id", "frame_index", "b.*")
    s = samples.join(best, ["video_id", "frame_index"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    hits = O.hit_streaks(s, "video_id", "frame_index", "hit", cfg.consecutive)
    segments = O.hits_to_segments(hits, "video_id", "timestamp_sec", "sim", cfg.join_gap, cfg.pre, cfg.post, F.col("duration_sec"))
    if cfg.validate:
        width = max(60.0, cfg.pre + cfg.post + cfg.join_gap)
        b = segments.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))))
        j = b.join(s.select("video_id", "timestamp_sec", "hit", F.floor(F.col("timestamp_sec") / width).alias("b")), ["video_id", "b"]).where("timestamp_sec between start_sec and end_sec")
        ok = j.groupBy("video_id", "start_sec", "end_sec").agg((F.sum(F.col("hit").cast("int")) / F.count("*")).alias("ratio")).where(F.col("ratio") >= cfg.least_ratio)
        segments = segments.join(ok.select("video_id", "start_sec", "end_sec"), ["video_id", "start_sec", "end_sec"], "left_semi")
    if cfg.max_clips:
        segments = O.ranked(segments, ["video_id"], ["start_sec", "end_sec"], "cap_").where(F.col("cap_") <= cfg.max_clips).drop("cap_")
    return K.clip_manifest(segments, "video_id").withColumn("duration", F.col("end_sec") - F.col("start_sec"))


def score_images(scores: DataFrame, cfg: ImageConfig = ImageConfig()) -> DataFrame:
    """scores (image, clip, nima, piq, brisque) with rating, decision and the name of the copy."""
    c = [F.col(x) for x in ("clip", "nima", "piq")]
    ok = {"gate": lambda: S.image_gate(*c), "ordered": lambda: S.image_rules_ordered(*c, F.col("brisque"), cfg.without_brisque), "all": lambda: S.image_rules_all(*c, F.col("brisque"))}[cfg.rules]()
    out = scores.withColumn("overall_rating", S.overall(*c)).withColumn("selected", F.coalesce(ok, F.lit(False)))
    out = O.numbered(out, ["selected"], ["image"])  # two groups only, so no group may meet in one task
    return out.withColumn("file", F.concat(F.when(F.col("selected"), "out").otherwise("reject"), F.col("rank").cast("string"), F.regexp_extract("image", r"(\.[^.]*)$", 1))).withColumn("slug", N.slug(F.col("image"))).drop("rank")
