"""Stateful selections: de-duplication, grouping, clustering, and what is computed from clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlane.functions import vectors as V
from prismlane.operators import folds as D
from prismlane.operators import mis as M
from prismlane.operators import ordered as O
from prismlane.operators import registry as R
from prismlane.sources.tables import BOXES_SQL, FRAMES_SQL, boxes, frames, load

DAY, DEDUP, REPLACE, GROUP, CLUSTER = 86400.0, 0.7, 0.72, 0.9, 0.30
BEST_FIRST = [("aesthetic", False), ("tech_score", False), ("frame_index", True)]


def greedy_dedup(spark, d):
    return D.greedy_dedup(frames(spark, d), "video_id", "embedding", BEST_FIRST, DEDUP, "frame_index")


def greedy_dedup_mis(spark, d):
    """The same rows by rounds over the similarity graph."""
    f = O.ranked(frames(spark, d), ["video_id"], [F.desc("aesthetic"), F.desc("tech_score"), "frame_index"]).select("video_id", "frame_index", "rank", "embedding")
    return M.greedy_independent(f, M.similarity_edges(f, "video_id", "frame_index", "rank", "embedding", DEDUP), "video_id", "frame_index")


def two_pass_topn(spark, d):
    """Stored frames joined to their vectors, best first, near ones suppressed, as many as the time budget allows."""
    f = frames(spark, d)
    budget = f.groupBy("video_id").agg(O.keep_budget(F.max("timestamp_sec"), 3 * DAY).alias("budget"))
    kept = D.greedy_dedup(f.where("aesthetic >= 0.2").join(budget, "video_id"), "video_id", "embedding", BEST_FIRST, DEDUP, "frame_index", "budget")
    return f.drop("embedding").join(kept.withColumn("k", F.lit(True)), ["video_id", "frame_index"], "left").select("video_id", "frame_index", F.coalesce("k", F.lit(False)).alias("is_representative"))


def dedup_replace(spark, d):
    return D.dedup_with_replacement(frames(spark, d), "video_id", "embedding", BEST_FIRST, "has_smile", "tech_score", REPLACE, "frame_index")


def windowed_face_dedup(spark, d):
    f = frames(spark, d).withColumn("face_hash", V.sign_hash(F.col("embedding")))
    return D.windowed_dedup(f, "video_id", "timestamp_sec", "face_hash", "embedding", "frame_index", window=5 * DAY, bits=22, least=0.5)


def final_dedup_chunks(spark, d):
    f = frames(spark, d).withColumn("chunk_id", F.floor(F.col("timestamp_sec") / (7 * DAY)))
    return D.final_dedup(f, "video_id", "chunk_id", "embedding", [("frame_index", True)], "has_smile", "tech_score", REPLACE, "frame_index")


def global_dedup(spark, d):
    """One registry over all survivors of the per-video pass over all frames, in rounds and without a group; the pass hands on what the registry reads."""
    f = D.greedy_dedup(frames(spark, d), "video_id", "embedding", BEST_FIRST, DEDUP, "frame_index", carry=("timestamp_sec", "aesthetic", "has_smile", "embedding"))
    f = f.withColumn("frame_id", F.col("video_id") * 1000000 + F.col("frame_index"))
    return R.one_registry(f, "embedding", [("video_id", True), ("timestamp_sec", True), ("frame_index", True)], "has_smile", "aesthetic", REPLACE, "frame_id")


def threshold_groups(spark, d):
    return D.grouped(frames(spark, d), "video_id", "embedding", [("frame_index", True)], "aesthetic", GROUP, "frame_index")


def _faces(spark, d):
    return load(spark, d, "embeddings").select(F.col("label").alias("scope"), "vec_id", "embedding")


def greedy_cluster(spark, d):
    return D.clustered(_faces(spark, d), "scope", "embedding", [("vec_id", True)], CLUSTER, "vec_id")


def cluster_sizes(spark, d):
    """Clusters of three or more, largest first."""
    c = greedy_cluster(spark, d).groupBy("scope", "cluster_id").agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id")).where("size >= 3")
    return O.ranked(c, ["scope"], [F.desc("size"), "cluster_id"]).select("scope", "cluster_id", "size", "first_id", F.col("rank").cast("long").alias("rank"))


def cluster_representative(spark, d):
    """The member nearest to the normalised plain mean."""
    f = _faces(spark, d).join(greedy_cluster(spark, d), ["scope", "vec_id"])
    mean = V.vector_mean(f, ["scope", "cluster_id"], "embedding")
    j = f.join(mean.withColumn("centroid", V.normalised(F.col("centroid"))), ["scope", "cluster_id"])
    j = j.withColumn("sim", F.round(V.dot(F.col("embedding"), F.col("centroid")), 6))
    return j.groupBy("scope", "cluster_id").agg(F.max_by("vec_id", F.struct("sim", -F.col("vec_id"))).alias("vec_id"))


def vector_mean(spark, d):
    m = V.vector_mean(load(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.round(F.col("centroid")[0], 6).alias("c0"), F.round(F.col("centroid")[63], 6).alias("c63"), F.round(V.norm(F.col("centroid")), 6).alias("length"))


def novel_images(spark, d):
    f = _faces(spark, d).withColumn("h", V.sign_hash(F.col("embedding")))
    return D.novel(f, "scope", "h", "embedding", [("vec_id", True)], "vec_id", bits=18, distance=0.7)


def adaptive_sampler(spark, d):
    f = frames(spark, d, vectors=False)
    return D.adaptively_sampled(f, "video_id", "frame_index", "has_smile", 5, 2, 3)


def track_continuity(spark, d):
    b = boxes(spark, d).withColumn("t", (F.col("event_id") % 1000).cast("double"))
    return D.tracked(b, "video_id", "t", ["x", "y", "w", "h"], "event_id", 0.3, 200.0)


def smoothed_boxes(spark, d):
    """Boxes of a video in time order, each side smoothed."""
    s = D.smooth_boxes(boxes(spark, d), "video_id", "event_id", ["x", "y", "w", "h"], "event_id")
    return s.select("video_id", "event_id", *[F.round(c, 6).alias(c) for c in "xywh"])


QUERIES = {f.__name__: f for f in (greedy_dedup, greedy_dedup_mis, two_pass_topn, dedup_replace, windowed_face_dedup, final_dedup_chunks, global_dedup, threshold_groups, greedy_cluster, cluster_sizes, cluster_representative, vector_mean, novel_images, adaptive_sampler, track_continuity, smoothed_boxes)}

_F = f"f as materialized ({FRAMES_SQL})"
_O = "o as materialized (select *, row_number() over (partition by video_id order by {}) i from f{})"
_BEST = "aesthetic desc, tech_score desc, frame_index"


def _greedy(where: str = "", cap: str = "true", order: str = _BEST) -> str:
    return f"""{_O.format(order, where)}, r(video_id, i, kept, ids) as (select video_id, 0::bigint, []::double[][], []::int[] from (select distinct video_id from o) union all
 select o.video_id, o.i, case when b.dup then r.kept else list_append(r.kept, o.embedding) end, case when b.dup then r.ids else list_append(r.ids, o.frame_index) end from r join o on o.video_id = r.video_id and o.i = r.i + 1{'' if cap == 'true' else ' join budget g on g.video_id = o.video_id'},
 lateral (select len(list_filter(r.kept, lambda k: 1 - list_dot_product(k, o.embedding) < {DEDUP}::double)) > 0 or not ({cap}) dup) b),
 k as (select video_id, unnest(ids) frame_index from (select video_id, ids, row_number() over (partition by video_id order by i desc) z from r) where z = 1)"""


_REPL = """r(grp, i, s, log) as (select grp, 0::bigint, []::struct(id bigint, v double[], sm boolean, q double)[], []::struct(id bigint, st varchar)[] from (select distinct grp from o) union all
 select o.grp, o.i, case when not b.dup then list_append(r.s, n.n) when b.take then list_transform(r.s, lambda x, ix: case when ix = j.j then n.n else x end) else r.s end,
 case when not b.dup then r.log when b.take then list_append(r.log, struct_pack(id := r.s[j.j].id, st := 'replaced')) else list_append(r.log, struct_pack(id := o.id, st := 'dedup')) end
 from r join o on o.grp = r.grp and o.i = r.i + 1, lateral (select struct_pack(id := o.id, v := o.embedding, sm := o.has_smile, q := o.q) n) n, lateral (select list_transform(r.s, lambda x: list_dot_product(x.v, o.embedding)) sims) w,
 lateral (select list_position(w.sims, list_max(w.sims)) j) j, lateral (select coalesce(1 - list_max(w.sims) < {thr}::double, false) dup, coalesce(case when o.has_smile <> r.s[j.j].sm then o.has_smile else o.q > r.s[j.j].q end, false) take) b),
 e as (select * from (select *, row_number() over (partition by grp order by i desc) z from r) where z = 1), lg as (select grp, unnest(log, recursive := true) from e), kp as (select grp, unnest(list_transform(s, lambda x: x.id)) id from e)"""
_CL = f"""o as materialized (select label scope, vec_id, embedding::double[] v, row_number() over (partition by label order by vec_id) i from embeddings),
 r(scope, i, s, lab) as (select scope, 0::bigint, []::struct(c double[], n bigint)[], []::bigint[] from (select distinct scope from o) union all
 select o.scope, o.i, case when b.hit then list_transform(r.s, lambda x, ix: case when ix = j.j then struct_pack(c := list_transform(x.c, lambda y, k: (y * x.n + o.v[k]) / nn.l), n := x.n + 1) else x end) else list_append(r.s, struct_pack(c := o.v, n := 1::bigint)) end,
 list_append(r.lab, case when b.hit then j.j - 1 else len(r.s) end) from r join o on o.scope = r.scope and o.i = r.i + 1, lateral (select list_transform(r.s, lambda x: list_dot_product(x.c, o.v)) sims) w,
 lateral (select list_position(w.sims, list_max(w.sims)) j) j, lateral (select coalesce(list_max(w.sims) >= {CLUSTER}::double, false) hit) b, lateral (select greatest(1e-9, sqrt(list_sum(list_transform(o.v, lambda y, k: (y + r.s[j.j].c[k] * r.s[j.j].n) * (y + r.s[j.j].c[k] * r.s[j.j].n))))) l) nn),
 cl as (select o.scope, o.vec_id, e.lab[o.i] cluster_id, o.v from (select scope, lab, row_number() over (partition by scope order by i desc) z from r) e join o on o.scope = e.scope where z = 1)"""
SQL = {
    "greedy_dedup": f"with recursive {_F}, {_greedy()} select * from k",
    "greedy_dedup_mis": f"with recursive {_F}, {_greedy()} select * from k",
    "two_pass_topn": f"""with recursive {_F}, budget as (select video_id, greatest(1, floor(max(timestamp_sec) / {3 * DAY}::double)::bigint) budget from f group by video_id), {_greedy(" where aesthetic >= 2e-1", "len(r.ids) < g.budget")}
 select f.video_id, f.frame_index, k.video_id is not null is_representative from f left join k on k.video_id = f.video_id and k.frame_index = f.frame_index""",
    "dedup_replace": f"""with recursive {_F}, o as materialized (select video_id grp, frame_index::bigint id, embedding, has_smile, tech_score q, row_number() over (partition by video_id order by {_BEST}) i from f), {_REPL.format(thr=REPLACE)}
 select grp video_id, id::int frame_index, st status from lg union all select grp, id::int, 'kept' from kp""",
    "windowed_face_dedup": f"""with recursive {_F}, o as materialized (select video_id, frame_index, timestamp_sec t, embedding v, list_transform(embedding[1:64], lambda x: x > 0) h, row_number() over (partition by video_id order by timestamp_sec, frame_index) i from f),
 r(video_id, i, s, ids) as (select video_id, 0::bigint, []::struct(t double, v double[], h boolean[])[], []::int[] from (select distinct video_id from o) union all
 select o.video_id, o.i, case when b.dup then r.s else list_append(r.s, struct_pack(t := o.t, v := o.v, h := o.h)) end, case when b.dup then r.ids else list_append(r.ids, o.frame_index) end from r join o on o.video_id = r.video_id and o.i = r.i + 1,
 lateral (select len(list_filter(r.s, lambda x: o.t - x.t <= {5 * DAY}::double and (list_dot_product(x.v, o.v) >= 5e-1 or list_sum(list_transform(x.h, lambda y, k: (y <> o.h[k])::int)) <= 22))) > 0 dup) b)
 select video_id, unnest(ids) frame_index from (select *, row_number() over (partition by video_id order by i desc) z from r) where z = 1""",
    "threshold_groups": f"""with recursive {_F}, {_O.format("frame_index", "")}, r(video_id, i, anchor, bv, bq, gid, bi) as (select video_id, 0::bigint, null::double[], null::double[], -1.0::double, -1::bigint, 0 from (select distinct video_id from o) union all
 select o.video_id, o.i, case when n.nw and r.bv is not null then r.bv else r.anchor end, case when n.nw or o.aesthetic > r.bq then o.embedding else r.bv end, case when n.nw then o.aesthetic else greatest(r.bq, o.aesthetic) end, r.gid + n.nw::int, case when n.nw or o.aesthetic > r.bq then o.frame_index else r.bi end
 from r join o on o.video_id = r.video_id and o.i = r.i + 1, lateral (select r.anchor is null or 1 - list_dot_product(r.anchor, o.embedding) > {GROUP}::double nw) n),
 g as (select video_id, gid, arg_max(bi, i) best from r where i > 0 group by video_id, gid) select r.video_id, o.frame_index, r.gid group_id, o.frame_index = g.best is_representative from r join o on o.video_id = r.video_id and o.i = r.i join g on g.video_id = r.video_id and g.gid = r.gid where r.i > 0""",
    "greedy_cluster": f"with recursive {_CL} select scope, vec_id, cluster_id from cl",
    "cluster_sizes": f"with recursive {_CL}, z as (select scope, cluster_id, count(*) size, min(vec_id) first_id from cl group by scope, cluster_id having count(*) >= 3) select *, row_number() over (partition by scope order by size desc, cluster_id) as rank from z",
    "cluster_representative": f"""with recursive {_CL}, m as (select scope, cluster_id, list(x order by p) c from (select scope, cluster_id, p, avg(v[p]) x from cl, (select unnest(range(1, 65)) p) group by scope, cluster_id, p) group by scope, cluster_id),
 s as (select cl.scope, cl.cluster_id, vec_id, round(list_dot_product(v, c) / greatest(1e-9, sqrt(list_dot_product(c, c))), 6) sim from cl join m using (scope, cluster_id)) select scope, cluster_id, vec_id from (select *, row_number() over (partition by scope, cluster_id order by sim desc, vec_id) r from s) where r = 1""",
    "vector_mean": "with m as (select label, list(x order by p) c from (select label, p, avg(embedding[p]::double) x from embeddings, (select unnest(range(1, 65)) p) group by label, p) group by label) select label, round(c[1], 6) c0, round(c[64], 6) c63, round(sqrt(list_dot_product(c, c)), 6) length from m",
    "adaptive_sampler": f"""with recursive {_F}, r(video_id, i, nxt, rest, take) as (select video_id, 0, null::int, 0, false from (select distinct video_id from f) union all
 select f.video_id, f.frame_index, case when k.t then f.frame_index + case when l.l > 0 then 2 else 5 end else r.nxt end, case when k.t then greatest(0, l.l - 1) else r.rest end, k.t
 from r join f on f.video_id = r.video_id and f.frame_index = r.i + 1, lateral (select r.nxt is null or f.frame_index >= r.nxt t) k, lateral (select case when k.t and f.has_smile then 3 else r.rest end l) l) select video_id, i frame_index from r where take""",
    "track_continuity": f"""with recursive b as materialized (select *, (event_id % 1000)::double t, row_number() over (partition by video_id order by event_id % 1000, event_id) i from ({BOXES_SQL})),
 r(video_id, i, event_id, linked, px, py, pw, ph, seen) as (select video_id, 0::bigint, null::bigint, false, null::bigint, null::bigint, null::bigint, null::bigint, null::double from (select distinct video_id from b) union all
 select b.video_id, b.i, b.event_id, k.ok, case when k.ok then b.x else r.px end, case when k.ok then b.y else r.py end, case when k.ok then b.w else r.pw end, case when k.ok then b.h else r.ph end, case when k.ok then b.t else r.seen end
 from r join b on b.video_id = r.video_id and b.i = r.i + 1, lateral (select greatest(0, least(r.px + r.pw, b.x + b.w) - greatest(r.px, b.x)) * greatest(0, least(r.py + r.ph, b.y + b.h) - greatest(r.py, b.y)) a) a,
 lateral (select r.seen is null or (b.t - r.seen <= 200 and a.a::double / (r.pw * r.ph + b.w * b.h - a.a + 1e-9) >= 3e-1) ok) k) select video_id, event_id, linked from r where i > 0""",
    "smoothed_boxes": f"""with recursive b as materialized (select *, row_number() over (partition by video_id order by event_id) i from ({BOXES_SQL})),
 r(video_id, i, event_id, x, y, w, h) as (select video_id, i, event_id, x::double, y::double, w::double, h::double from b where i = 1 union all
 select b.video_id, b.i, b.event_id, 35e-2 * b.x + (1e0 - 35e-2) * r.x, 35e-2 * b.y + (1e0 - 35e-2) * r.y, 35e-2 * b.w + (1e0 - 35e-2) * r.w, 35e-2 * b.h + (1e0 - 35e-2) * r.h from r join b on b.video_id = r.video_id and b.i = r.i + 1)
 select video_id, event_id, round(x, 6) x, round(y, 6) y, round(w, 6) w, round(h, 6) h from r""",
    "novel_images": """with recursive o as materialized (select label scope, vec_id, embedding::double[] v, list_transform(embedding[1:64], lambda x: x > 0) h, row_number() over (partition by label order by vec_id) i from embeddings),
 r(scope, i, s, ids) as (select scope, 0::bigint, []::struct(v double[], h boolean[])[], []::bigint[] from (select distinct scope from o) union all
 select o.scope, o.i, case when b.dup then r.s else list_append(r.s, struct_pack(v := o.v, h := o.h)) end, case when b.dup then r.ids else list_append(r.ids, o.vec_id) end from r join o on o.scope = r.scope and o.i = r.i + 1,
 lateral (select len(list_filter(r.s, lambda x: 1 - list_dot_product(x.v, o.v) <= 7e-1 or list_sum(list_transform(x.h, lambda y, k: (y <> o.h[k])::int)) <= 18)) > 0 dup) b)
 select scope, unnest(ids) vec_id from (select *, row_number() over (partition by scope order by i desc) z from r) where z = 1""",
    "final_dedup_chunks": f"""with recursive {_F}, o as materialized (select video_id, frame_index, embedding v, has_smile sm, tech_score q, floor(timestamp_sec / {7 * DAY}::double)::bigint c, row_number() over (partition by video_id order by floor(timestamp_sec / {7 * DAY}::double), frame_index) i from f),
 r(video_id, i, c, idx, done, s) as (select video_id, 0::bigint, -1::bigint, []::double[][], []::int[], []::struct(id int, v double[], sm boolean, q double)[] from (select distinct video_id from o) union all
 select o.video_id, o.i, o.c, n.idx, n.done, case when b.old then n.s when not b.dup then list_append(n.s, w.me) when b.take then list_transform(n.s, lambda x, ix: case when ix = j.j then w.me else x end) else n.s end
 from r join o on o.video_id = r.video_id and o.i = r.i + 1, lateral (select case when o.c <> r.c then list_concat(r.idx, list_transform(r.s, lambda x: x.v)) else r.idx end idx, case when o.c <> r.c then list_concat(r.done, list_transform(r.s, lambda x: x.id)) else r.done end done, case when o.c <> r.c then r.s[1:0] else r.s end s) n,
 lateral (select struct_pack(id := o.frame_index, v := o.v, sm := o.sm, q := o.q) me, list_transform(n.s, lambda x: list_dot_product(x.v, o.v)) sims) w, lateral (select list_position(w.sims, list_max(w.sims)) j) j,
 lateral (select len(list_filter(n.idx, lambda x: 1 - list_dot_product(x, o.v) < {REPLACE}::double)) > 0 old, coalesce(1 - list_max(w.sims) < {REPLACE}::double, false) dup, coalesce(case when o.sm <> n.s[j.j].sm then o.sm else o.q > n.s[j.j].q end, false) take) b),
 e as (select video_id, list_concat(done, list_transform(s, lambda x: x.id)) ids from (select *, row_number() over (partition by video_id order by i desc) z from r) where z = 1)
 select f.video_id, f.frame_index, list_contains(e.ids, f.frame_index) kept from f join e on e.video_id = f.video_id""",
}
