"""The four pipelines: every input has one decision, selections obey their rules, settings are read."""

import pytest
from pyspark.sql import functions as F

from prismlane.__main__ import settings
from prismlane.config import ClusterConfig, ImageConfig, KeyframeConfig, PersonConfig
from prismlane.functions import vectors as V
from prismlane.plans import pipelines as P
from prismlane.plans import queries_more as Q
from prismlane.sources.tables import image_scores

from .conftest import SMALL


@pytest.fixture(scope="module")
def frames(spark):
    return Q._easy(Q.frame_features(spark, SMALL)).cache()


def test_keyframes(frames):
    cfg = KeyframeConfig(min_tech=25.0, dedup=0.75, chunk_sec=7 * 86400.0, max_frames=6)
    selected, decisions = P.keyframes(frames, cfg)
    d = decisions.collect()
    assert len(d) == frames.count() and all((r["reason"] is None) == (r["status"] == "selected") for r in d)
    s = selected.collect()
    assert {(r["video_id"], r["frame_index"]) for r in s} == {(r["video_id"], r["frame_index"]) for r in d if r["status"] == "selected"}
    by = {}
    for r in sorted(s, key=lambda r: (r["video_id"], r["rank"])):
        assert r["rank"] == by.get(r["video_id"], 0) + 1 and r["clip" if "clip" in r else "aesthetic"] is not None
        by[r["video_id"]] = r["rank"]
    none, all_ = P.keyframes(frames.limit(0), cfg)
    assert none.count() == all_.count() == 0


def test_thresholds_off_keep_all_good(frames):
    _, d = P.keyframes(frames, KeyframeConfig(min_tech=0.0, dedup=0.0, chunk_sec=7 * 86400.0))
    assert {r["reason"] for r in d.select("reason").distinct().collect()}.isdisjoint({"dedup", "replaced", "final_dedup", "max_frames"})
    _, short = P.keyframes(frames, KeyframeConfig(max_seconds=86400.0))
    assert short.count() == frames.where("timestamp_sec < 86400").count()


def test_clusters(spark):
    faces = Q._detections(spark, SMALL)
    clusters, segments = P.face_clusters(faces, ClusterConfig(min_sharpness=20.0, similarity=0.2, min_size=2, per_video=False))
    rows = clusters.collect()
    assert rows and all(r["size"] >= 2 for r in rows) and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    assert segments.where("end_sec - start_sec <= 0.05").count() == 0
    nan = faces.withColumn("embedding", F.array(F.lit(float("nan"))))
    assert P.face_clusters(nan)[0].count() == 0


def test_person(spark):
    faces = Q._detections(spark, SMALL)
    samples = faces.select("video_id", "frame_index", F.col("t").alias("timestamp_sec"), F.lit(30 * 86400.0).alias("duration_sec"))
    photo = list(map(float, faces.orderBy("face_id").first()["embedding"]))
    easy = PersonConfig(match=0.0, consecutive=1, every_photo=True, join_gap=86400.0, min_area=0.0, min_sharpness=0.0, least_ratio=0.0)
    clips = P.person_clips(faces, samples, [photo], easy)
    assert clips.count() > 0 and clips.where("start_sec < 0 or duration <= 0").count() == 0
    assert P.person_clips(faces, samples, [photo], PersonConfig(match=2.0)).count() == 0
    one = P.person_clips(faces, samples, [photo], PersonConfig(match=0.0, consecutive=1, min_area=0.0, min_sharpness=0.0, validate=False, max_clips=1))
    assert one.groupBy("video_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("rules", ["gate", "ordered", "all"])
def test_images(spark, rules):
    s = image_scores(spark, SMALL).withColumn("image", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    out = P.score_images(s, ImageConfig(rules)).collect()
    assert len(out) == s.count() and len({r["file"] for r in out}) == len(out)
    assert all(not r["selected"] for r in out if r["nima"] is None and rules != "ordered")


def test_settings():
    assert settings(KeyframeConfig, ["dedup=0.2", "max_frames=5", "ghosts=True"]) == KeyframeConfig(dedup=0.2, max_frames=5, ghosts=True)
    with pytest.raises(SystemExit):
        settings(KeyframeConfig, ["nope=1"])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.norm(F.col("a")).alias("n"), V.normalised(F.col("a")).alias("u"), V.finite(F.col("a"), 2).alias("f"), V.finite(F.col("a"), 3).alias("g")).first()
    assert (r["d"], r["n"], r["f"], r["g"]) == (4.0, 5.0, True, False) and r["u"] == pytest.approx([0.6, 0.8])
    h = spark.createDataFrame([("ffffffffffffffff",), ("000000000000000f",)], "h string").select(V.hash_from_hex(F.col("h")).alias("h"), V.hamming(V.hash_from_hex(F.col("h")), F.lit(0).cast("long")).alias("b")).collect()
    assert [(x["h"], x["b"]) for x in h] == [(-1, 64), (15, 4)]


def test_sql_functions(spark):
    from prismlane.functions import sql

    assert "pl_dot" in sql.register(spark)
    row = spark.sql("""select pl_dot(array(1D, 2D), array(3D, 4D)) d, pl_norm(array(3D, 4D)) n, pl_hamming(7L, 0L) h, pl_hash_from_hex('ffffffffffffffff') x, pl_overall(1D, 2D, null) o,
        pl_selection_gate(5D, 5D, 0.9D) g, pl_image_gate(5D, 5D, null) i, pl_iou(0, 0, 10, 10, 0, 0, 10, 10) u, pl_slug('A b') s, pl_sampling_step(0D, 2D) t""").first()
    assert (row["d"], row["n"], row["h"], row["x"], row["o"], row["g"], row["i"], row["s"], row["t"]) == (11.0, 5.0, 3, -1, None, True, False, "a_b", 12)
    assert row["u"] == pytest.approx(1.0)
    plan = spark.sql("select v, c.* from values (1, 700D), (2, 0D) t(v, dur), lateral pl_chunk_plan(dur, 300D) c order by 1, 2").collect()
    assert [(r["v"], r["chunk_id"], r["end_sec"]) for r in plan] == [(1, 0, 300.0), (1, 1, 600.0), (1, 2, 700.0), (2, 0, None)]


def test_two_pass(spark):
    """Against a plain reading: cascade, best first within the budget, near ones out, then the sharpness of the stored image."""
    from prismlane.config import TwoPassConfig

    f = Q.two_pass_frames(spark, SMALL)
    cfg = TwoPassConfig(sec_per_image=3 * 86400.0, dedup=0.7, min_aesthetic=0.3)
    selected, decisions = P.two_pass_keyframes(f, cfg)
    rows = {(r["video_id"], r["frame_index"]): r for r in decisions.collect()}
    source = f.collect()
    assert len(rows) == len(source)
    by = {}
    for r in source:
        by.setdefault(r["video_id"], []).append(r)
    for video, mine in by.items():
        most = max(1, int(max(r["timestamp_sec"] for r in mine) / cfg.sec_per_image))
        kept = []
        for r in sorted(mine, key=lambda r: (-r["aesthetic"], r["frame_index"])):
            if rows[video, r["frame_index"]]["reason"] in (None, "dedup_or_budget", "blur_after_dedup") and len(kept) < most:
                if all(1 - sum(a * b for a, b in zip(r["embedding"], k["embedding"])) >= cfg.dedup for k in kept):
                    kept.append(r)
        sharp = {r["frame_index"] for r in kept if max([*r["final_roi_sharpness"], r["final_sharpness"]]) >= cfg.min_sharpness}
        assert {i for v, i in rows if v == video and rows[v, i]["is_representative"]} == sharp
    assert {(r["video_id"], r["frame_index"]) for r in selected.collect()} == {k for k, r in rows.items() if r["is_representative"]}
    assert {"text", "blur_after_dedup", "dedup_or_budget"} <= {r["reason"] for r in rows.values()}
    none, all_ = P.two_pass_keyframes(f.limit(0), cfg)
    assert none.count() == all_.count() == 0


def test_speakers(spark):
    segments = spark.createDataFrame([("c1", "v", 10.0, 20.0), ("c2", "v", 30.0, 40.0), ("c3", "w", 0.0, 5.0), ("c4", "v", 7000.0, 7300.0)], "clip_id string, video_id string, start_sec double, end_sec double")
    seen = spark.createDataFrame([("c1", 12.0), ("c1", 12.3), ("c1", 50.0), ("c4", 7210.0)], "clip_id string, t double")
    turns = [("v", "x", 10.0, 11.9), ("v", "y", 12.0, 12.4), ("v", "y", 12.42, 13.0), ("v", "x", 14.0, 19.0), ("v", "x", 19.5, 19.6), ("v", "y", 31.0, 32.0), ("v", "x", 33.0, 39.0), ("v", "y", 7000.0, 7100.0), ("v", "x", 7100.0, 7300.0)]
    got = {r["clip_id"]: r for r in P.speaker_clips(segments, seen, spark.createDataFrame(turns, "video_id string, speaker string, start_sec double, end_sec double")).collect()}
    assert (got["c1"]["speaker"], got["c1"]["gate"]) == ("y", "between(t,2.000,3.000)") and got["c1"]["score"] == pytest.approx(0.45)
    assert (got["c2"]["speaker"], got["c2"]["score"], got["c2"]["gate"]) == ("x", 6.0, "between(t,3.000,9.000)")
    assert got["c3"]["speaker"] is None and got["c3"]["gate"] is None
    assert (got["c4"]["speaker"], got["c4"]["gate"]) == ("x", "between(t,100.000,300.000)")


def test_query_photos(spark):
    from prismlane import __main__ as M

    rows = spark.createDataFrame([([float(k)],) for k in range(M.MOST_PHOTOS + 1)], "embedding array<double>")
    assert [r["embedding"][0] for r in M.query_photos(rows.where("embedding[0] < 100"))] == [float(k) for k in range(100)]
    with pytest.raises(SystemExit):
        M.query_photos(rows)
