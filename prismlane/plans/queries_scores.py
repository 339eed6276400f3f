"""Scores, gates, geometry and names: column expressions only, so each is one scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlane.functions import geometry as G
from prismlane.functions import naming as N
from prismlane.functions import scores as S
from prismlane.functions import vectors as V
from prismlane.operators import joins as J
from prismlane.sources.tables import BOXES_SQL, PIXELS_SQL, SCORES_SQL, boxes, image_scores, load, pixels

TECH_COLS = ("sharpness_var", "noise_sigma", "clip_shadows", "clip_highlights", "mean_luma", "color_cast")


def _tech():
    return S.tech_score(*map(F.col, TECH_COLS))


def tech_score(spark, d):
    return pixels(spark, d).select("event_id", F.round(_tech(), 4).alias("tech_score"))


def overall_rating(spark, d):
    return image_scores(spark, d).select("image_id", F.round(S.overall(F.col("clip"), F.col("nima"), F.col("piq")), 6).alias("overall_rating"))


def selection_gate(spark, d):
    return image_scores(spark, d).where(S.selection_gate(F.col("clip"), F.col("nima"), F.col("piq"))).select("image_id")


def image_select_v5(spark, d):
    ok = S.image_gate(F.col("clip"), F.col("nima"), F.col("piq"))
    return image_scores(spark, d).select("image_id", F.when(ok, "selected").otherwise("rejected").alias("decision"))


def image_rules_v4(spark, d):
    return image_scores(spark, d).select("image_id", S.image_rules_ordered(*map(F.col, ("clip", "nima", "piq", "brisque"))).alias("passes"))


def image_rules_v3(spark, d):
    return image_scores(spark, d).where(S.image_rules_all(*map(F.col, ("clip", "nima", "piq", "brisque")))).select("image_id")


def composition_score(spark, d):
    c = G.composition(F.col("subject_x"), F.col("subject_y"))
    return pixels(spark, d).select("event_id", *[F.round(v, 4).alias(k) for k, v in c.items()])


def face_quality(spark, d):
    q = G.face_quality(F.col("face_conf"), F.col("face_rel_area"))
    return pixels(spark, d).select("event_id", F.round(q, 4).alias("face_quality"), F.round(G.tilt(F.col("eye_dy"), F.col("eye_dx")), 4).alias("tilt"))


def black_slate(spark, d):
    return pixels(spark, d).where(S.black_slate(F.col("bright_share"), F.col("mean_luma"), F.col("max_luma"))).select("event_id")


def quality_linear(spark, d):
    return pixels(spark, d).select("event_id", F.round(S.linear_quality(F.col("sharpness_var"), F.col("noise_sigma"), F.col("aesthetic"), 1.0, 0.25, 0.5), 6).alias("quality"))


def body_bbox(spark, d):
    b = G.body_rect(*map(F.col, "xywh"), 640, 480)
    return boxes(spark, d).select("event_id", *[v.cast("long").alias(k) for k, v in b.items()])


def crop_rect(spark, d):
    b = G.crop_rect(*map(F.col, "xywh"), 640, 480)
    return boxes(spark, d).select("event_id", *[v.cast("long").alias(k) for k, v in b.items()])


def padded_bbox(spark, d):
    b = G.padded_even(*map(F.col, "xywh"), 640, 480)
    return boxes(spark, d).select("event_id", *[v.cast("long").alias(k) for k, v in b.items()])


def slug_filename(spark, d):
    p = pixels(spark, d)
    return p.select("event_id", N.slug(F.concat(F.initcap("event_type"), F.lit(" @ "), F.format_string("%.2f", "aesthetic"))).alias("slug"), N.frame_file(F.col("event_id"), F.col("sharpness_var")).alias("file"), N.duration_text(F.col("event_id") * 7).alias("duration"))


def clashing_names(spark, d):
    p = pixels(spark, d).select("event_id", F.concat("event_type", F.lit(".jpg")).alias("name"))
    return N.without_clashes(p, "name", ["event_id"]).select("event_id", "file")


def early_gates(spark, d):
    tech = _tech()
    p = pixels(spark, d)
    first = S.early_gate(F.col("sharpness_var"), F.col("noise_sigma"), F.col("clip_shadows"), F.col("clip_highlights"), tech, F.col("face_sharpness"))
    framing = S.framing_gate(F.col("face_rel_area") * 500 + 20, F.col("face_rel_area") * 400 + 30, F.col("width"), F.col("height"))
    return p.select("event_id", F.coalesce(first, framing, F.lit("kept")).alias("reason"))


def _decided(spark, d):
    p = pixels(spark, d).withColumn("tech", _tech()).withColumn("tilt", G.tilt(F.col("eye_dy"), F.col("eye_dx")))
    return p.withColumn("reason", S.decision({c: F.col(c) for c in p.columns}, min_tech=40.0))


def decision_log(spark, d):
    return _decided(spark, d).select("event_id", "video_id", "reason")


def reason_counts(spark, d):
    return _decided(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def reason_rollup(spark, d):
    return _decided(spark, d).rollup("event_type", "reason").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def hash_hamming(spark, d):
    """All rows against the query rows (ids divisible by 50): sign hashes that differ in 7 bits at most."""
    h = load(spark, d, "embeddings").select("vec_id", V.sign_hash(F.col("embedding")).alias("h"))
    hex_ = F.lpad(F.lower(F.hex("h")), 16, "0")
    h = h.select("vec_id", V.hash_from_hex(hex_).alias("h"))
    q = h.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"))
    return J.near_hashes(h, q, "h", "qh", 7).select("query_id", "vec_id", V.hamming(F.col("h"), F.col("qh")).cast("long").alias("bits"))


QUERIES = {f.__name__: f for f in (tech_score, overall_rating, selection_gate, image_select_v5, image_rules_v4, image_rules_v3, composition_score, face_quality, black_slate, quality_linear, body_bbox, crop_rect, padded_bbox, slug_filename, clashing_names, early_gates, decision_log, reason_counts, reason_rollup, hash_hamming)}

_up1 = "least(1.0::double, {})".format
_PARTS = [_up1("sharpness_var / 100e0"), *("1e0 - " + _up1(x) for x in ("noise_sigma / 8e-2", "clip_shadows / 1e-2", "clip_highlights / 1e-2"))]
_PARTS += ["greatest(0e0, " + _up1("case when mean_luma < 2e-1 then mean_luma / 2e-1 when mean_luma > 8e-1 then (1e0 - mean_luma) / 2e-1 else 1e0 end") + ")", "1e0 - " + _up1("color_cast / 10e0")]
_TECH = "(100e0 * ((" + " + ".join(f"({x})" for x in _PARTS) + ") / 6e0))"
_OVER = "((clip + nima) * piq)"
_GATE = f"coalesce(clip >= 5e0 and nima >= 475e-2 and piq >= 7e-1 and {_OVER} >= 8e0, false)"
_SIZE = "case when face_rel_area <= 0 then 0e0 when face_rel_area < 5e-2 then face_rel_area / 5e-2 when face_rel_area > 4e-1 then greatest(0e0, 1e0 - (face_rel_area - 4e-1) / 4e-1) else 1e0 end"
_THIRD = "least(" + ", ".join(f"sqrt((subject_x - {a}e0/3e0) * (subject_x - {a}e0/3e0) + (subject_y - {b}e0/3e0) * (subject_y - {b}e0/3e0))" for a in (1, 2) for b in (1, 2)) + ")"
_SLATE = "((bright_share < 5e-2 and mean_luma < 5e-2) or (mean_luma < 5e-2 and max_luma - mean_luma > 5e-1))"
_DECIDE = f"""case when greatest(width, height) < 320 or width * height < 200000 then 'low_resolution' when tech < 40 then 'low_tech_score' when {_SLATE} then 'black_frame'
 when not sure and ((skin > 5e-2 and motion > 2) or person_ratio > 5e-2) then 'faceless_not_scenic' when has and face_sharpness < 60 then 'face_too_blurry'
 when has and abs(degrees(atan2(eye_dy, eye_dx))) > 35 then 'face_tilted' when has and face_rel_area < 2e-2 then 'face_too_small' when has and subject_y < 5e-2 then 'face_too_low' when overlay_card then 'overlay_card'
 when sharpness_var < 80 and skin >= 5e-2 and not (has and face_sharpness >= 40) then 'global_blur' when aesthetic < case when sure then 0 else 5 end then 'low_aesthetic'
 when not (aesthetic >= 5e0 and nima >= 475e-2 and piq >= 7e-1 and (aesthetic + nima) * piq >= 8e0) then 'score' else 'kept' end"""
_DECIDED = f"with p as ({PIXELS_SQL}), t as (select *, {_TECH} tech, skin >= 5e-2 and num_faces > 0 has, skin >= 5e-2 and num_faces > 0 and face_conf >= 3e-1 sure from p), r as (select *, {_DECIDE} reason from t)"
_cut = "trunc({})::bigint".format

SQL = {
    "tech_score": f"with p as ({PIXELS_SQL}) select event_id, round({_TECH}, 4) tech_score from p",
    "overall_rating": f"with s as ({SCORES_SQL}) select image_id, round({_OVER}, 6) overall_rating from s",
    "selection_gate": f"with s as ({SCORES_SQL}) select image_id from s where {_GATE}",
    "image_select_v5": f"with s as ({SCORES_SQL}) select image_id, case when clip >= 5 and nima >= 5 and piq >= 8e-1 and {_OVER} >= 9 then 'selected' else 'rejected' end decision from s",
    "image_rules_v4": f"""with s as ({SCORES_SQL}) select image_id, case when {_OVER} <= 55e-1 then false when clip >= 6 then true when nima >= 55e-1 then true when clip + nima >= 105e-1 then true when piq >= 85e-2 then true
 when {_OVER} >= 8 then true when clip is null or nima is null or piq is null then false else clip >= 5 and nima >= 5 and piq >= 65e-2 and coalesce(brisque <= 40, false) end passes from s""",
    "image_rules_v3": f"with s as ({SCORES_SQL}) select image_id from s where clip >= 5 and nima >= 5 and piq >= 4e-1 and brisque <= 40",
    "composition_score": f"""with p as ({PIXELS_SQL}), c as (select event_id, greatest(0e0, least(1e0, 1e0 - {_THIRD} / 25e-2)) t, greatest(0e0, least(1e0, 1e0 - (abs(subject_x - 5e-1) + abs(subject_y - 5e-1)) / 2e-1)) m,
 greatest(0e0, least(1e0, least(subject_x, 1e0 - subject_x, subject_y, 1e0 - subject_y) / 1e-1)) e from p)
 select event_id, round(t, 4) thirds, round(m, 4) centred, round(e, 4) edge, round(100e0 * (((5e-1 * t + 5e-1 * m) + e) / 2e0), 4) composition_score from c""",
    "face_quality": f"with p as ({PIXELS_SQL}) select event_id, round(100e0 * (6e-1 * face_conf + 4e-1 * greatest(0e0, least(1e0, {_SIZE}))), 4) face_quality, round(degrees(atan2(eye_dy, eye_dx)), 4) tilt from p",
    "black_slate": f"with p as ({PIXELS_SQL}) select event_id from p where {_SLATE}",
    "quality_linear": f"with p as ({PIXELS_SQL}) select event_id, round(1e0 * sharpness_var + 25e-2 * noise_sigma + 5e-1 * aesthetic, 6) quality from p",
    "body_bbox": f"""with b as ({BOXES_SQL}), s as (select *, {_cut("greatest(1e0, w * 18e-1)")} nw, {_cut("greatest(1e0, h * 3e0)")} nh, {_cut("greatest(0e0, y - 3e-1 * h)")} y0 from b),
 t as (select *, greatest(0, {_cut("x + w / 2e0 - nw / 2e0")}) x0 from s), u as (select event_id, case when x0 + nw > 640 then greatest(0, 640 - nw) else x0 end bx, case when y0 + nh > 480 then greatest(0, 480 - nh) else y0 end as by_, least(640, x0 + nw) x1, least(480, y0 + nh) y1 from t)
 select event_id, bx, by_ as "by", greatest(1, x1 - bx) bw, greatest(1, y1 - by_) bh from u""",
    "crop_rect": f"""with b as ({BOXES_SQL}), s as (select *, {_cut("greatest(w, h) * 125e-2")} sz from b), t as (select event_id, sz, greatest(0, {_cut("x + w / 2e0 - sz / 2e0")}) x0, greatest(0, {_cut("y + h / 2e0 - sz / 2e0")}) y0 from s)
 select event_id, x0, y0, least(640, x0 + sz) x1, least(480, y0 + sz) y1 from t""",
    "padded_bbox": f"""with b as ({BOXES_SQL}), t as (select event_id, greatest(0, {_cut("x - w * 2e-1")}) x0, greatest(0, {_cut("y - h * 2e-1")}) y0, least(640, {_cut("x + w * 12e-1")}) x1, least(480, {_cut("y + h * 12e-1")}) y1 from b)
 select event_id, x0 px, y0 py, (x1 - x0) - (x1 - x0) % 2 pw, (y1 - y0) - (y1 - y0) % 2 ph from t""",
    "slug_filename": f"""with p as ({PIXELS_SQL}), s as (select *, event_id * 7 s from p) select event_id, regexp_replace(lower(event_type || ' @ ' || printf('%.2f', round(aesthetic::varchar::decimal(24, 12), 2)::double)), '[^a-z0-9_-]', '_', 'g') slug, printf('%09d', event_id) || '_t' || printf('%.2f', round(sharpness_var::varchar::decimal(24, 12), 2)::double) || '.jpg' file,
 case when s >= 3600 then printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm %02ds', s // 60, s % 60) else printf('%ds', s) end duration from s""",
    "clashing_names": "select event_id, case when k = 0 then event_type || '.jpg' else event_type || '_' || k || '.jpg' end file from (select event_id, event_type, row_number() over (partition by event_type order by event_id) - 1 k from events)",
    "early_gates": f"""with p as ({PIXELS_SQL}), t as (select *, {_TECH} tech, face_rel_area * 500 + 20 fw, face_rel_area * 400 + 30 fh from p) select event_id, case when sharpness_var < 80 and not face_sharpness >= 40 then 'too_blurry' when noise_sigma > 12e-2 then 'too_noisy' when clip_shadows > 5e-2 or clip_highlights > 5e-2 then 'heavy_clipping'
 when tech < 70 then 'low_tech_score' when least(fw, fh) / least(width, height) < 12e-2 then 'face_too_small' when not (fw / fh between 6e-1 and 18e-1) then 'face_aspect_weird' else 'kept' end reason from t""",
    "decision_log": f"{_DECIDED} select event_id, video_id, reason from r",
    "reason_counts": f"{_DECIDED} select reason, count(*) n from r group by reason",
    "reason_rollup": f"{_DECIDED} select event_type, reason, count(*) n, grouping(event_type, reason)::bigint as level from r group by rollup(event_type, reason)",
    "hash_hamming": """with h as (select vec_id, list_transform(embedding[1:64], lambda x: x > 0) s from embeddings), p as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: (a.s[i] <> b.s[i])::bigint))::bigint bits from h a join h b on a.vec_id % 50 = 0)
 select query_id, vec_id, bits from p where bits <= 7""",
}
