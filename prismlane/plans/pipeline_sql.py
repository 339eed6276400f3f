"""The SQL that must give the rows of the pipelines' queries, put together from the folds' recursive forms."""

from __future__ import annotations

from prismlane.plans.queries_folds import _REPL, _greedy
from prismlane.plans.queries_scores import _TECH
from prismlane.sources.tables import FRAMES_SQL, PIXELS_SQL

DAY = 86400.0
_F = f"f as materialized ({FRAMES_SQL})"
_text = "case when {0} is null then 'NA' else printf('%.2f', round(({0})::varchar::decimal(24, 12), 2)::double) end".format

# keyframes: the cascade, six a chunk, replacement within the chunk, then across chunks
_KEYFRAMES = f"""{_F}, p as ({PIXELS_SQL}),
 t as (select p.event_id, p.video_id, p.width, p.height, {_TECH} tech, p.bright_share, p.mean_luma / 2 + 3e-1 mean_luma, p.max_luma, p.skin >= 5e-2 run_face, p.skin >= 5e-2 and p.num_faces > 0 has, p.face_sharpness + 50 face_sharpness,
  degrees(atan2(p.eye_dy, p.eye_dx)) tilt, p.face_rel_area, p.subject_y, p.overlay_card, p.sharpness_var, p.aesthetic + 5 aesthetic, p.nima, p.piq / 4 + 72e-2 piq, f.frame_index, f.timestamp_sec, f.has_smile, f.embedding from p join f on p.event_id = f.event_id),
 d as materialized (select *, (aesthetic + nima) * piq overall, floor(timestamp_sec / {7 * DAY}::double)::bigint c, case when greatest(width, height) < 320 or width * height < 200000 then 'low_resolution' when tech < 25 then 'low_tech_score'
  when (bright_share < 5e-2 and mean_luma < 5e-2) or (mean_luma < 5e-2 and max_luma - mean_luma > 5e-1) then 'black_frame' when has and face_sharpness < 60 then 'face_too_blurry' when has and abs(tilt) > 35 then 'face_tilted'
  when has and face_rel_area < 0 then 'face_too_small' when has and subject_y < 0 then 'face_too_low' when overlay_card then 'overlay_card' when sharpness_var < 80 and run_face and not (has and face_sharpness >= 40) then 'global_blur'
  when aesthetic < 0 then 'low_aesthetic' when not (aesthetic >= 5 and nima >= 475e-2 and piq >= 7e-1 and (aesthetic + nima) * piq >= 8) then 'score' else 'kept' end reason from t),
 good as materialized (select * from (select *, row_number() over (partition by video_id, c order by frame_index) cap from d where reason = 'kept') where cap <= 6),
 o as materialized (select video_id || ':' || c grp, frame_index::bigint id, embedding, has_smile, overall q, row_number() over (partition by video_id, c order by aesthetic desc, frame_index) i from good), {_REPL.format(thr=0.75)},
 s1 as materialized (select g.* from good g join kp on kp.grp = g.video_id || ':' || g.c and kp.id = g.frame_index),
 o2 as materialized (select video_id, frame_index, embedding v, has_smile sm, overall q, c, row_number() over (partition by video_id order by c, aesthetic desc, frame_index) i from s1),
 r2(video_id, i, c, idx, done, s) as (select video_id, 0::bigint, -1::bigint, []::double[][], []::int[], []::struct(id int, v double[], sm boolean, q double)[] from (select distinct video_id from o2) union all
  select o2.video_id, o2.i, o2.c, n.idx, n.done, case when b.old then n.s when not b.dup then list_append(n.s, w.me) when b.take then list_transform(n.s, lambda x, ix: case when ix = j.j then w.me else x end) else n.s end
  from r2 join o2 on o2.video_id = r2.video_id and o2.i = r2.i + 1,
  lateral (select case when o2.c <> r2.c then list_concat(r2.idx, list_transform(r2.s, lambda x: x.v)) else r2.idx end idx, case when o2.c <> r2.c then list_concat(r2.done, list_transform(r2.s, lambda x: x.id)) else r2.done end done, case when o2.c <> r2.c then r2.s[1:0] else r2.s end s) n,
  lateral (select struct_pack(id := o2.frame_index, v := o2.v, sm := o2.sm, q := o2.q) me, list_transform(n.s, lambda x: list_dot_product(x.v, o2.v)) sims) w, lateral (select list_position(w.sims, list_max(w.sims)) j) j,
  lateral (select len(list_filter(n.idx, lambda x: 1 - list_dot_product(x, o2.v) < 0.75::double)) > 0 old, coalesce(1 - list_max(w.sims) < 0.75::double, false) dup, coalesce(case when o2.sm <> n.s[j.j].sm then o2.sm else o2.q > n.s[j.j].q end, false) take) b),
 e2 as (select video_id, unnest(list_concat(done, list_transform(s, lambda x: x.id))) frame_index from (select *, row_number() over (partition by video_id order by i desc) z from r2) where z = 1),
 z as materialized (select d.*, case when d.reason <> 'kept' then d.reason when g.frame_index is null then 'max_frames' when lg.st is not null then lg.st when e2.frame_index is null then 'final_dedup' end why
  from d left join good g on g.video_id = d.video_id and g.frame_index = d.frame_index left join lg on lg.grp = d.video_id || ':' || d.c and lg.id = d.frame_index left join e2 on e2.video_id = d.video_id and e2.frame_index = d.frame_index)"""

# faces: filter, window of five seconds, centroid clusters a video
_FACES = f"""{_F}, a0 as (select video_id, event_id face_id, timestamp_sec t, frame_index, (event_id % 47) / 1e2 area_ratio, (event_id % 120)::double sharpness, embedding v, list_transform(embedding[1:64], lambda x: x > 0) h from f)"""
_CLUSTERS = f"""{_FACES}, o0 as materialized (select *, row_number() over (partition by video_id order by t, face_id) i from a0 where area_ratio >= 2e-2 and sharpness >= 20),
 r0(video_id, i, s, ids) as (select video_id, 0::bigint, []::struct(t double, v double[], h boolean[])[], []::bigint[] from (select distinct video_id from o0) union all
  select o0.video_id, o0.i, case when b.dup then r0.s else list_append(list_filter(r0.s, lambda x: o0.t - x.t <= 5), struct_pack(t := o0.t, v := o0.v, h := o0.h)) end, case when b.dup then r0.ids else list_append(r0.ids, o0.face_id) end from r0 join o0 on o0.video_id = r0.video_id and o0.i = r0.i + 1,
  lateral (select len(list_filter(r0.s, lambda x: o0.t - x.t <= 5 and (list_dot_product(x.v, o0.v) >= 995e-3 or list_sum(list_transform(x.h, lambda y, k: (y <> o0.h[k])::int)) <= 6))) > 0 dup) b),
 k0 as (select video_id, unnest(ids) face_id from (select *, row_number() over (partition by video_id order by i desc) z from r0) where z = 1),
 o as materialized (select o0.video_id::varchar scope, o0.video_id, o0.face_id, o0.t, o0.v, row_number() over (partition by o0.video_id order by o0.t, o0.face_id) i from o0 join k0 using (video_id, face_id)),
 r(scope, i, s, lab) as (select scope, 0::bigint, []::struct(c double[], n bigint)[], []::bigint[] from (select distinct scope from o) union all
  select o.scope, o.i, case when b.hit then list_transform(r.s, lambda x, ix: case when ix = j.j then struct_pack(c := list_transform(x.c, lambda y, k: (y * x.n + o.v[k]) / nn.l), n := x.n + 1) else x end) else list_append(r.s, struct_pack(c := o.v, n := 1::bigint)) end,
  list_append(r.lab, case when b.hit then j.j - 1 else len(r.s) end) from r join o on o.scope = r.scope and o.i = r.i + 1, lateral (select list_transform(r.s, lambda x: list_dot_product(x.c, o.v)) sims) w,
  lateral (select list_position(w.sims, list_max(w.sims)) j) j, lateral (select coalesce(list_max(w.sims) >= 2e-1, false) hit) b, lateral (select greatest(1e-9, sqrt(list_sum(list_transform(o.v, lambda y, k: (y + r.s[j.j].c[k] * r.s[j.j].n) * (y + r.s[j.j].c[k] * r.s[j.j].n))))) l) nn),
 c0 as (select o.*, e.lab[o.i] cluster_id from (select scope, lab, row_number() over (partition by scope order by i desc) z from r) e join o on o.scope = e.scope where z = 1),
 cl as materialized (select * from (select *, count(*) over (partition by scope, cluster_id) size from c0) where size >= 2)"""

# the first program: cascade, budgeted suppression over what passes, prune
_TWO_PASS = f"""f0 as materialized ({FRAMES_SQL}), p as ({PIXELS_SQL}), t as (select *, event_id % 5 k, skin > 6e-2 or person_ratio * 2 > 12e-2 od from p),
 g as materialized (select event_id, case when not od and k <= 1 then 'no_person' when not od and person_ratio * 2 < 5e-2 then 'person_small' when not od and k <= 2 then 'indoor_no_face' when not od and face_rel_area / 4 < 2e-2 then 'face_small'
  when k <= 1 and not max_luma > 5e-1 then 'no_scene_no_person' when text_prominent then 'text' when not (sharpness_var >= 50 or (k > 2 and face_sharpness >= 50)) and not (od and max_luma > 5e-1 and aesthetic - 1e-1 >= 3e-1) then 'blur' when aesthetic < 3e-1 then 'low_aesthetic' end gate from t),
 f as materialized (select f0.* from f0 join g using (event_id) where gate is null), budget as (select video_id, greatest(1, floor(max(timestamp_sec) / {3 * DAY}::double)::bigint) budget from f0 group by video_id),
 {_greedy("", "len(r.ids) < g.budget", "aesthetic desc, frame_index")}"""

_PERSON = f"""{_FACES}, e0 as (select vec_id, embedding::double[] v from embeddings where vec_id < 2), m as (select list(x order by i) c from (select i, avg(v[i]) x from e0, (select unnest(range(1, 65)) i) group by i)),
 n as (select list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-9)) c from m),
 x as (select a0.video_id, a0.frame_index, max(list_dot_product(a0.v, e0.v)) smax, any_value(list_dot_product(a0.v, n.c)) sc from a0, e0, n where area_ratio >= 2e-2 and sharpness >= 20 group by a0.video_id, a0.frame_index, a0.face_id),
 s as materialized (select a0.video_id, a0.frame_index, a0.t, coalesce(x.smax >= 5e-2 and x.sc >= 5e-2 - 5e-2, false) hit, x.smax sim from a0 left join x on x.video_id = a0.video_id and x.frame_index = a0.frame_index),
 h as (select *, t - lag(t) over (partition by video_id order by t) > {DAY}::double brk from s where hit), i as (select *, sum(coalesce(brk::int, 1)) over (partition by video_id order by t rows unbounded preceding) isle from h),
 g as materialized (select video_id, greatest(0e0, min(t) - 600) start_sec, least({30 * DAY}::double, max(t) + 600) end_sec, count(*) hits, max(sim) best_sim from i group by video_id, isle),
 ok as (select g.video_id, g.start_sec, g.end_sec from g join s on s.video_id = g.video_id and s.t between g.start_sec and g.end_sec where g.end_sec > g.start_sec group by g.video_id, g.start_sec, g.end_sec having sum(s.hit::int) / count(*) >= 3e-1)"""

_merged = """select {k}, min(s) s, max(e) e from (select *, sum(coalesce((s > far + {gap})::int, 1)) over (partition by {k} order by s, e rows unbounded preceding) isle from
  (select *, max(e) over (partition by {k} order by s, e rows between unbounded preceding and 1 preceding) far from {src})) group by {k}, isle""".format
_SPEAKERS = f"""{_F}, i0 as (select video_id, timestamp_sec s, timestamp_sec + 40000 e from f where has_smile), c as materialized (select video_id || ':' || floor(s)::bigint clip_id, video_id, s a, e b from ({_merged(k="video_id", gap="0", src="i0")})),
 w0 as (select clip_id, greatest(0e0, timestamp_sec - a - 9000) s, least(b - a, timestamp_sec - a + 9000) e from c join f using (video_id) where has_smile and timestamp_sec >= a and timestamp_sec < b), w as materialized ({_merged(k="clip_id", gap="10", src="w0")}),
 u as (select clip_id, event_type speaker, clip_id || '/' || event_type who, greatest(a, timestamp_sec) - a s, least(b, timestamp_sec + tech_score * 600) - a e from c join f using (video_id) where not has_smile and a < timestamp_sec + tech_score * 600 and timestamp_sec < b),
 v0 as ({_merged(k="who", gap="1", src="u")}), v as materialized (select split_part(who, '/', 1) clip_id, split_part(who, '/', 2) speaker, s, e from v0 where e - s >= 60),
 b as (select v.clip_id, speaker, sum(least(w.e, v.e) - greatest(w.s, v.s)) shared from w join v on w.clip_id = v.clip_id and w.s < v.e and v.s < w.e group by v.clip_id, speaker),
 k as (select v.clip_id, v.speaker, case when exists (select 1 from w where w.clip_id = v.clip_id) then coalesce(any_value(b.shared), 0) else sum(v.e - v.s) end score from v left join b on b.clip_id = v.clip_id and b.speaker = v.speaker group by v.clip_id, v.speaker),
 best as (select clip_id, speaker, score from (select *, row_number() over (partition by clip_id order by round(score, 6) desc, speaker) z from k) where z = 1)"""

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "input_listing": f"select unnest({_TABLES}) as name",
    "keyframes_decisions": f"with recursive {_KEYFRAMES} select case when why is null then 'selected' else 'rejected' end status, why reason, count(*) n from z group by all",
    "keyframes_pipeline": f"""with recursive {_KEYFRAMES}, x as (select *, row_number() over (partition by video_id order by timestamp_sec, frame_index)::int as rank from z where why is null)
 select video_id, frame_index, timestamp_sec, aesthetic, nima, piq, overall, rank, 'out' || rank || '_t' || {_text("timestamp_sec")} || '_clip-' || {_text("aesthetic")} || '.jpg' file from x""",
    "face_clusters_pipeline": f"""with recursive {_CLUSTERS}, m as (select scope, cluster_id, list(x order by p) c from (select scope, cluster_id, p, avg(v[p]) x from cl, (select unnest(range(1, 65)) p) group by scope, cluster_id, p) group by scope, cluster_id),
 b as (select scope, cluster_id, size, face_id, row_number() over (partition by scope, cluster_id order by round(list_dot_product(v, c) / greatest(1e-9, sqrt(list_dot_product(c, c))), 9) desc, t) z from cl join m using (scope, cluster_id)),
 x as (select scope, cluster_id, size, face_id representative, row_number() over (partition by scope order by size desc, cluster_id)::int as rank from b where z = 1) select *, 'face' || rank as name from x""",
    "face_segments_pipeline": f"""with recursive {_CLUSTERS}, y as (select scope || ':' || cluster_id || ':' || video_id as key, greatest(0e0, t - 18e2) s, greatest(0e0, t - 18e2) + 36e2 e from cl), x as ({_merged(k="key", gap=f"{DAY}::double", src="y")})
 select key, s start_sec, e end_sec, printf('clip_%03d.mp4', row_number() over (partition by key order by s, e) - 1) clip, 'clips/' || key as dir from x where e > s + 5e-2 and e - s > 5e-2""",
    "person_clips_pipeline": f"""with {_PERSON} select g.video_id, g.start_sec, g.end_sec, hits, round(best_sim, 6) best_sim, printf('clip_%03d.mp4', row_number() over (partition by g.video_id order by g.start_sec, g.end_sec) - 1) clip, 'clips/' || g.video_id as dir, g.end_sec - g.start_sec duration
 from g join ok using (video_id, start_sec, end_sec) where g.end_sec - g.start_sec > 5e-2""",
    "two_pass_pipeline": f"""with recursive {_TWO_PASS} select f0.video_id, f0.frame_index, g.gate is null and k.video_id is not null and (f0.event_id % 10) * 20e0 >= 50 is_representative,
 case when g.gate is not null then g.gate when k.video_id is null then 'dedup_or_budget' when not (f0.event_id % 10) * 20e0 >= 50 then 'blur_after_dedup' end reason from f0 join g using (event_id) left join k on k.video_id = f0.video_id and k.frame_index = f0.frame_index""",
    "speaker_pipeline": f"with {_SPEAKERS} select c.clip_id, best.speaker, round(best.score, 2) score from c left join best using (clip_id)",
}
