"""Joins: equi, range, as-of, interval overlap, similarity, merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prismlane.functions import geometry as G
from prismlane.functions import vectors as V
from prismlane.operators import joins as J
from prismlane.operators import ordered as O
from prismlane.sources import sinks as K
from prismlane.sources.tables import BOXES_SQL, FRAMES_SQL, SCORES_SQL, boxes, frames, image_scores, load

DAY = 86400.0


def frames_join_embeddings(spark, d):
    f = frames(spark, d).where("aesthetic >= 1").withColumn("sum3", F.round(V.doubles(F.col("embedding"))[0] + V.doubles(F.col("embedding"))[1], 5))
    return f.select("video_id", "frame_index", "vec_id", F.size("embedding").cast("long").alias("dim"), "sum3")


def scores_left_join(spark, d):
    return image_scores(spark, d).select("image_id", F.round("clip", 4).alias("clip"), F.round("nima", 4).alias("nima"), "brisque")


def iou_pairs(spark, d):
    """Boxes of one frame that overlap the target (the first box) by 0.3 or more are its own; the others are listed."""
    b = boxes(spark, d)
    first = b.withColumn("r", F.row_number().over(W.partitionBy("video_id", "frame_idx").orderBy("event_id"))).where("r = 1")
    t = first.select("video_id", "frame_idx", *[F.col(c).alias(f"t{c}") for c in "xywh"], F.col("event_id").alias("target_id"))
    j = b.join(t, ["video_id", "frame_idx"]).where("event_id <> target_id")
    i = G.iou(*map(F.col, ("tx", "ty", "tw", "th")), *map(F.col, "xywh"))
    return j.withColumn("iou", F.round(i, 6)).where("iou < 0.3").select("target_id", "event_id", "iou")


def cosine_topk(spark, d):
    """The three nearest of all vectors for each query row (ids divisible by 50), rows and queries in blocks."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    top = J.top_similar(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 3)
    return top.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "sim")


def query_match(spark, d):
    e = load(spark, d, "embeddings")
    photos = [list(map(float, r["embedding"])) for r in e.where("vec_id < 3").orderBy("vec_id").collect()]
    mean = [sum(p[k] for p in photos) / len(photos) for k in range(len(photos[0]))]
    size = sum(x * x for x in mean) ** 0.5 + 1e-9
    m = J.match_queries(e, photos, [x / size for x in mean], "embedding", 0.2, 0.05, every=False)
    return m.select("vec_id", F.round("smin", 5).alias("smin"), F.round("smax", 5).alias("smax"), F.round("scentre", 5).alias("scentre"), "hit")


def range_dedup_candidates(spark, d):
    f = frames(spark, d, vectors=False)
    a = f.where("has_smile").select("video_id", F.col("event_id").alias("a"), F.col("timestamp_sec").alias("ta"))
    b = f.where("event_type = 'view'").select("video_id", F.col("event_id").alias("b"), F.col("timestamp_sec").alias("tb"))
    return J.within(a, b, "video_id", "ta", "tb", 3600.0).select("video_id", "a", "b", F.round(F.abs(F.col("ta") - F.col("tb")), 3).alias("gap"))


def nearest_detection(spark, d):
    f = frames(spark, d, vectors=False).select("video_id", "event_id", (F.floor(F.col("timestamp_sec") / 600) * 2).cast("long").alias("t"), "event_type")
    left, right = f.where("event_type = 'view'").select("video_id", "event_id", "t"), f.where("event_type = 'click'").select("video_id", F.col("t").alias("rt"))
    return J.nearest(left, right, "video_id", "t", "rt", 100).select("video_id", "event_id", "t", "matched")


def exact_detection(spark, d):
    """The first stored box of the very frame, of all boxes; null where the frame has none."""
    f = frames(spark, d, vectors=False).select("video_id", "frame_index", "event_id")
    b = boxes(spark, d).groupBy("video_id", F.col("frame_idx").alias("frame_index")).agg(F.min_by(F.struct("x", "y"), "event_id").alias("b"))
    return f.join(b, ["video_id", "frame_index"], "left").select("video_id", "frame_index", F.col("b.x").alias("x"), F.col("b.y").alias("y"))


def speaker_overlap(spark, d):
    """Who speaks most while the person (clicks) is present; people are event types, intervals from hits and turns."""
    f = frames(spark, d, vectors=False)
    p = O.merge_intervals(f.where("has_smile").select("video_id", F.col("timestamp_sec").alias("s"), (F.col("timestamp_sec") + 40000).alias("e")), "video_id", "s", "e", 0.0)
    t = f.where("not has_smile").select("video_id", F.col("event_type").alias("speaker"), F.col("timestamp_sec").alias("s2"), (F.col("timestamp_sec") + F.col("tech_score") * 600).alias("e2"))
    o = J.overlaps(p, t, "video_id", DAY).groupBy("video_id", "speaker").agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("total"))
    best = o.groupBy("video_id").agg(F.min_by(F.struct("speaker", "total"), F.struct(-F.round("total", 2), "speaker")).alias("b"))
    return best.select("video_id", "b.speaker", F.round("b.total", 2).alias("total"))


def index_anti(spark, d):
    f = frames(spark, d).select("video_id", "frame_index", "embedding", "timestamp_sec")
    cut = 15 * DAY
    return J.not_in_index(f.where(F.col("timestamp_sec") >= cut), f.where(F.col("timestamp_sec") < cut), ["video_id"], "embedding", 0.6).select("video_id", "frame_index")


def clear_previous(spark, d):
    f = frames(spark, d, vectors=False).select("video_id", "frame_index")
    return K.without_videos(f, f.where("video_id % 4 = 0"), "video_id").groupBy("video_id").agg(F.count("*").alias("n"))


def upsert_groups(spark, d):
    f = frames(spark, d, vectors=False)
    old = f.groupBy("video_id").agg(F.min("frame_index").alias("start_index"), F.max("frame_index").alias("end_index"), F.lit(None).cast("long").alias("selected")).where("video_id % 3 <> 0")
    new = f.where("aesthetic >= 2").groupBy("video_id").agg(F.lit(None).cast("int").alias("start_index"), F.max("frame_index").alias("end_index"), F.max("event_id").alias("selected"))
    return K.upsert(old, new, ["video_id"]).select("video_id", "start_index", "end_index", "selected")


def insert_faces(spark, d):
    f = boxes(spark, d).select(F.concat_ws(":", "video_id", "frame_idx").alias("face_id"), "event_id")
    first = lambda x: x.groupBy("face_id").agg(F.min("event_id").alias("event_id"))
    return K.insert_if_absent(first(f.where("event_id % 2 = 0")), first(f.where("event_id % 2 = 1")), ["face_id"])


def set_operations(spark, d):
    a = frames(spark, d, vectors=False).where("aesthetic >= 1").select("video_id", "frame_index")
    b = frames(spark, d, vectors=False).where("tech_score >= 50").select("video_id", "frame_index")
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.exceptAll(b).withColumn("part", F.lit("first"))).groupBy("part").agg(F.count("*").alias("n"), F.sum("frame_index").alias("s"))


QUERIES = {f.__name__: f for f in (frames_join_embeddings, scores_left_join, iou_pairs, cosine_topk, query_match, range_dedup_candidates, nearest_detection, exact_detection, speaker_overlap, index_anti, clear_previous, upsert_groups, insert_faces, set_operations)}

_F = f"f as ({FRAMES_SQL})"
SQL = {
    "frames_join_embeddings": f"with {_F} select video_id, frame_index, vec_id, len(embedding) dim, round(embedding[1] + embedding[2], 5) sum3 from f where aesthetic >= 1",
    "scores_left_join": f"with s as ({SCORES_SQL}) select image_id, round(clip, 4) clip, round(nima, 4) nima, brisque from s",
    "iou_pairs": f"""with b as ({BOXES_SQL}), t as (select * from (select *, row_number() over (partition by video_id, frame_idx order by event_id) r from b) where r = 1),
 p as (select t.event_id target_id, b.event_id, greatest(0, least(t.x + t.w, b.x + b.w) - greatest(t.x, b.x)) * greatest(0, least(t.y + t.h, b.y + b.h) - greatest(t.y, b.y)) i, t.w * t.h + b.w * b.h u from b join t using (video_id, frame_idx) where b.event_id <> t.event_id)
 select target_id, event_id, round(i::double / (u - i::double + 1e-9), 6) iou from p where round(i::double / (u - i::double + 1e-9), 6) < 3e-1""",
    "cosine_topk": """with e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query_id, e.vec_id, round(list_sum(list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] * q.v[i])), 6) sim from e join e q on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id)
 select query_id, vec_id, rank, sim from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s) where rank <= 3""",
    "query_match": """with e as (select vec_id, embedding::double[] v from embeddings), q as (select v from e where vec_id < 3), m as (select list(x order by i) c from (select i, avg(v[i]) x from q, (select unnest(range(1, 65)) i) group by i)),
 n as (select list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-9)) c from m), s as (select e.vec_id, min(list_dot_product(e.v, q.v)) smin, max(list_dot_product(e.v, q.v)) smax from e, q group by e.vec_id)
 select vec_id, round(smin, 5) smin, round(smax, 5) smax, round(list_dot_product(e.v, n.c), 5) scentre, smax >= 2e-1 and list_dot_product(e.v, n.c) >= 2e-1 - 5e-2 hit from s join e using (vec_id), n""",
    "range_dedup_candidates": f"with {_F} select a.video_id, a.event_id a, b.event_id b, round(abs(a.timestamp_sec - b.timestamp_sec), 3) gap from f a join f b on a.video_id = b.video_id and a.has_smile and b.event_type = 'view' and abs(a.timestamp_sec - b.timestamp_sec) <= 3600",
    "nearest_detection": f"""with {_F}, t as (select video_id, event_id, floor(timestamp_sec / 600)::bigint * 2 t, event_type from f), l as (select * from t where event_type = 'view'), r as (select distinct video_id, t rt from t where event_type = 'click'),
 j as (select l.video_id, l.event_id, l.t, r.rt, row_number() over (partition by l.event_id order by abs(r.rt - l.t), r.rt desc) k from l left join r on r.video_id = l.video_id and abs(r.rt - l.t) <= 100) select video_id, event_id, t, rt matched from j where k = 1""",
    "exact_detection": f"""with {_F}, b as ({BOXES_SQL}), m as (select video_id, frame_idx, arg_min(x, event_id) x, arg_min(y, event_id) y from b group by video_id, frame_idx)
 select f.video_id, f.frame_index, m.x, m.y from f left join m on m.video_id = f.video_id and m.frame_idx = f.frame_index""",
    "speaker_overlap": f"""with {_F}, c as (select video_id, timestamp_sec s, timestamp_sec + 40000 e from f where has_smile), i as (select *, sum(coalesce((s > far)::int, 1)) over (partition by video_id order by s, e rows unbounded preceding) isle from (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) far from c)),
 p as (select video_id, min(s) s, max(e) e from i group by video_id, isle), t as (select video_id, event_type speaker, timestamp_sec s2, timestamp_sec + tech_score * 600 e2 from f where not has_smile),
 o as (select video_id, speaker, round(sum(least(e, e2) - greatest(s, s2)), 2) total from p join t using (video_id) where s < e2 and s2 < e group by video_id, speaker) select video_id, speaker, total from (select *, row_number() over (partition by video_id order by total desc, speaker) r from o) where r = 1""",
    "index_anti": f"""with {_F} select video_id, frame_index from f where timestamp_sec >= {15 * DAY}::double and not exists (select 1 from f g where g.video_id = f.video_id and g.timestamp_sec < {15 * DAY}::double and 1 - list_dot_product(f.embedding, g.embedding) < 6e-1)""",
    "clear_previous": f"with {_F} select video_id, count(*) n from f where video_id % 4 <> 0 group by video_id",
    "upsert_groups": f"""with {_F}, o as (select video_id, min(frame_index) a, max(frame_index) b from f where video_id % 3 <> 0 group by video_id), n as (select video_id, max(frame_index) b, max(event_id) s from f where aesthetic >= 2 group by video_id)
 select coalesce(o.video_id, n.video_id) video_id, o.a start_index, coalesce(n.b, o.b) end_index, n.s selected from o full join n on o.video_id = n.video_id""",
    "insert_faces": f"with b as (select video_id || ':' || frame_idx face_id, event_id from ({BOXES_SQL})) select face_id, coalesce(min(case when event_id % 2 = 0 then event_id end), min(event_id)) event_id from b group by face_id",
    "set_operations": f"with {_F} select case when tech_score >= 50 then 'both' else 'first' end part, count(*) n, sum(frame_index)::bigint s from f where aesthetic >= 1 group by 1",
}
