"""Pixel kernels, plug-ins, sources, sinks, intervals and streams on hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlane.functions import pixels as P
from prismlane.functions import scores as S
from prismlane.functions.scorers import ScorerRegistry, linear_head
from prismlane.operators import joins as J
from prismlane.operators import ordered as O
from prismlane.sources import files, sinks
from prismlane.streaming import flows


def test_laplacian_and_hashes():
    g = np.zeros((3, 3))
    g[1, 1] = 1
    centre = np.array([[0, 2, 0], [2, -4, 2], [0, 2, 0]], float)  # borders reflect: the centre is met from both sides
    assert P.laplacian_variance(g) == pytest.approx(centre.var())
    assert P.laplacian_variance(np.full((4, 4), 7.0)) == 0
    board = np.indices((8, 8)).sum(axis=0) % 2 * 255.0
    assert P.average_hash(board).bit_count() == 32
    assert P.average_hash(np.full((16, 16), 3.0)) == 0
    assert P.clipping(np.full((4, 4), 0.5)) == (0.0, 0.0)
    assert P.noise_sigma(np.full((8, 8, 3), 9, np.uint8)) == 0.0
    assert P.motion(np.zeros((2, 2, 3)), np.full((2, 2, 3), 5)) == 5


def test_colours():
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 2] = 255
    assert P.hsv(red)[0, 0].tolist() == [0, 255, 255]
    assert P.hsv(red[..., ::-1])[0, 0].tolist() == [120, 255, 255]
    assert P.colour_cast(np.full((4, 4, 3), 128, np.uint8)) == pytest.approx(0, abs=0.02)
    assert P.lab(red)[0, 0].tolist() == pytest.approx([53.24, 80.09, 67.20], abs=0.05)
    assert P.skin_share(red) == 1.0
    assert P.overlay_card(P.overlay_strips(red)) and not P.overlay_card(P.overlay_strips(np.full((8, 8, 3), 90, np.uint8)))


def test_features_on_frames(spark):
    img = np.random.default_rng(0).integers(0, 255, (12, 10, 3), dtype=np.uint8)
    df = spark.createDataFrame([("a", 12, 10, bytearray(img.tobytes()))], "path string, h int, w int, bgr binary")
    row = P.with_features(df).first()
    assert row["sharpness_var"] == pytest.approx(P.laplacian_variance(P.gray(img))) and 0 < row["mean_luma"] < 1
    assert P.with_features(df.where(F.lit(False))).count() == 0
    assert row["overlay_card"] == P.overlay_card(P.overlay_strips(img)) and row["text_prominent"] == P.text_prominent(img)


def test_islands():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.4
        label, box = P.islands(mask)
        left, found = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
        while left:
            todo, mine = [left.pop()], []
            while todo:
                y, x = todo.pop()
                mine.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*mine)
            found.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(mine)))
            assert len({int(label[p]) for p in mine}) == 1 and label[mine[0]] > 0
        assert sorted(found) == sorted(map(tuple, box.tolist())) and ((label > 0) == mask).all()


def test_box_morphology():
    rng = np.random.default_rng(3)
    mask = rng.random((9, 11)) < 0.5
    for h, w in ((1, 5), (3, 3), (3, 5), (1, 15)):
        want = np.array([[mask[max(0, y - h // 2) : y + h // 2 + 1, max(0, x - w // 2) : x + w // 2 + 1].any() for x in range(11)] for y in range(9)])
        assert (P._box_max(mask, h, w) == want).all()
        assert (P._opened(mask, h, w) <= mask).all() and (P._closed(mask, h, w) >= mask).all()


def test_text_prominent():
    """Rows of strokes over a smooth picture count in the middle, low ones only when tall; a smooth picture has none."""
    smooth = np.repeat(np.tile(np.linspace(60, 200, 320)[None, :, None], (180, 1, 1)), 3, axis=2).astype(np.uint8)

    def lettered(y, size):
        img = smooth.copy()
        for k in range(8, 300, 2 * size):  # letters like an H
            for a, b, c, d in ((0, size, 0, size // 3), (0, size, size - size // 3, size), (size // 3, 2 * size // 3, 0, size)):
                img[y + a : y + b, k + c : k + d] = 5
        return img

    flat = np.full((90, 160, 3), 128, np.uint8)
    assert P.text_prominent(flat) and not P.text_prominent(flat, letters_only=True) and not P.text_prominent(smooth, letters_only=True)
    big, low = lettered(80, 24), lettered(150, 9)
    assert P.text_prominent(big) and P.text_prominent(big, subtitles=True, letters_only=True)
    assert not P.text_prominent(low, subtitles=True, letters_only=True)
    assert P._local_mean(np.full((40, 50), 7.0)) == pytest.approx(7.0)


def test_smoothed_boxes_and_state(spark):
    from prismlane.operators import folds as D

    df = spark.createDataFrame([("v", 1, 0, 10), ("v", 2, 10, 10), ("v", 3, 10, 20), ("w", 1, 5, 5)], "v string, t long, x long, y long")
    got = {(r["v"], r["t"]): (r["x"], r["y"]) for r in D.smooth_boxes(df, "v", "t", ["x", "y"], "t", 0.5).collect()}
    assert got == {("v", 1): (0, 10), ("v", 2): (5, 10), ("v", 3): (7.5, 15), ("w", 1): (5, 5)}


def test_state_expires(spark, tmp_path):
    """A key's rows leave the state once the watermark is a window beyond them."""
    from prismlane.streaming import flows as T

    schema = "v string, t double, at timestamp, e array<double>, i int"
    make = lambda rows, n: spark.createDataFrame(rows, "v string, t double, e array<double>, i int").select("v", "t", F.timestamp_seconds("t").alias("at"), "e", "i").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    sink, log = str(tmp_path / "out"), str(tmp_path / "log")
    rows_in_state = []
    for n, rows in enumerate(([("a", 1.0, [1.0, 0.0], 1), ("a", 2.0, [1.0, 0.0], 2)], [("b", 1000.0, [1.0, 0.0], 3)], [("b", 2000.0, [1.0, 0.0], 4)])):
        make(rows, n)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")).withWatermark("at", "1 second")
        out = T.lately_unseen(stream, "v", "t", "e", "i", 10.0, 0.9, "v string, i int", event_time="at")
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        rows_in_state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r["i"] for r in spark.read.parquet(sink).collect()) == [1, 3, 4]
    assert rows_in_state[-1] <= 1


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from prismlane import shared

    conf = {"spark.master": "spark://host:7077"}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__))
    with pytest.raises(RuntimeError):
        shared.shared_dir(fake)
    conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert shared.shared_dir(fake) == "hdfs://shared"
    conf.clear()
    conf["spark.master"] = "local[2]"
    assert shared.shared_dir(fake).startswith("file://")


def test_registry(spark):
    reg = ScorerRegistry()
    reg.register("twice", lambda: (lambda s: s * 2.0))
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    out = reg.apply(df, "x", ["twice", "absent"]).collect()
    assert [r["twice"] for r in out] == [2.0, 4.0] and out[0]["absent"] is None and "twice" in reg
    v = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert v.select(linear_head(F.col("v"), [3.0, 4.0], 0.5).alias("s")).first()["s"] == 11.5


def test_listing_and_tables(spark, tmp_path):
    for n in ("a.MP4", "b.txt", "sub/c.mkv"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"xx")
    got = [r["path"].rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()]
    assert got == ["a.MP4", "c.mkv"]
    assert [r["path"] for r in files.named(spark, "x.jpg, y.jpg,").collect()] == ["x.jpg", "y.jpg"]
    (tmp_path / "t.md").write_text("| Image | Score |\n|---|---|\n| p.jpg | 1.5 |\n| q.jpg | N/A |\n")
    assert {tuple(r) for r in files.markdown_scores(spark, str(tmp_path / "t.md")).collect()} == {("p.jpg", 1.5), ("q.jpg", None)}
    v = files.videos(spark.createDataFrame([("p", 0.0, 10), ("p", 0.0, 10), ("q", 5.0, 10)], "path string, fps double, frame_count int"))
    assert {(r["path"], r["fps"], r["duration_sec"]) for r in v.collect()} == {("p", 25.0, 0.0), ("q", 5.0, 2.0)}


def test_frame_source(spark):
    spark.dataSource.register(files.frame_source(lambda path, i: (1, 1, bytes([i % 256] * 3)), "tiny_frames"))
    df = spark.read.format("tiny_frames").options(path="v", frames="20", fps="10", step="3", chunk="7").load()
    assert [r["frame_index"] for r in df.orderBy("frame_index").collect()] == list(range(0, 20, 3))


def test_vector_bytes_and_stored(spark):
    raw = np.array([3.0, 4.0], "<f4").tobytes()
    df = files.vector_from_bytes(spark.createDataFrame([("v:r:1", bytearray(raw)), ("v:r:2", None)], "frame_id string, blob binary"), "blob")
    assert df.where("embedding is not null").first()["embedding"] == [3.0, 4.0]
    frames = spark.createDataFrame([("v:r:1", "v", 1, 0.5, None)], "frame_id string, video_id string, frame_index int, quality double, aesthetic double")
    out = files.stored_frames(frames, df.select("frame_id", "embedding"), "v", "r", 2).first()
    assert out["aesthetic"] == 0.0 and out["embedding"] == pytest.approx([0.6, 0.8])
    assert files.stored_frames(frames, df.select("frame_id", "embedding"), "v", "r", 3).count() == 0


def test_segments_edges(spark):
    h = spark.createDataFrame([("v", t, 0.5) for t in (0.0, 0.2, 5.0, 5.5)], "v string, t double, s double")
    got = sorted((r["start_sec"], r["end_sec"], r["hits"]) for r in O.hits_to_segments(h, "v", "t", "s", 2.0, 1.0, 1.0, F.lit(6.0)).collect())
    assert got == [(0.0, 1.2, 2), (4.0, 6.0, 2)]
    got = sorted((r["start_sec"], r["end_sec"]) for r in O.build_segments(h, "v", "t", 0.0, 0.0, 0.5, 0.5).collect())
    assert got == [(0.0, 0.5), (4.75, 5.75)]
    m = spark.createDataFrame([("v", i, bool(x)) for i, x in enumerate([1, 0, 1, 1, 0, 1, 1, 1])], "v string, i int, m boolean")
    assert sorted(r["i"] for r in O.hit_streaks(m, "v", "i", "m", 2).collect()) == [3, 6, 7]
    assert sorted(r["i"] for r in O.hit_streaks(m, "v", "i", "m", 3).collect()) == [7]
    assert O.hits_to_segments(h.where("t < 0"), "v", "t", "s", 1.0, 1.0, 1.0).count() == 0


def test_rounding_is_half_to_even(spark):
    row = spark.createDataFrame([(5.0,), (0.0,), (None,)], "fps double").select(O.sampling_step(F.col("fps"), 2.0).alias("s")).collect()
    assert [r["s"] for r in row] == [2, 12, 12]


def test_nearest_ties_and_tolerance(spark):
    a = spark.createDataFrame([("k", 10, 1), ("k", 50, 2), ("x", 1, 3)], "k string, t int, id int")
    b = spark.createDataFrame([("k", 8), ("k", 12)], "k string, rt int")
    got = {r["id"]: r["matched"] for r in J.nearest(a, b, "k", "t", "rt", 5).collect()}
    assert got == {1: 12, 2: None, 3: None}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, s string")
    new = spark.createDataFrame([("a", None, "y"), ("c", 3, "z")], "k string, n int, s string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {("a", 1, "y"), ("b", 2, None), ("c", 3, "z")}
    assert {r["k"] for r in sinks.insert_if_absent(old, new, ["k"]).where("n is not null").collect()} == {"a", "b", "c"}
    sinks.write_csv(spark.createDataFrame([(1.23456, "q")], "t double, f string"), str(tmp_path / "c"), {"t": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["t"] == "1.235"
    sinks.write_frames(old, str(tmp_path / "f"), "k")
    sinks.write_frames(spark.createDataFrame([("a", 9, "n")], "k string, n int, s string"), str(tmp_path / "f"), "k")
    assert {(r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {("a", 9), ("b", 2)}
    assert sinks.markdown_header("i", ["a", "b"]) == ["| i | a | b |", "|---|---|---|"]


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [("v", f"2024-01-01 00:00:{s:02d}", s, float(x)) for s, x in enumerate([1, 5, 5, 2, 9, 9, 1, 7])] + [("v", "2024-01-02 00:00:00", 99, 0.0)]
    df = spark.createDataFrame(rows, "v string, ts string, i int, q double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("w", flows.best_per_window(s, "v", "ts", "i", "q", "4 seconds")), ("s", flows.sessions(s, "v", "ts", "q", "5 seconds"))):
        for _ in range(2):  # the second run closes what the first one's watermark passed
            q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}c")).trigger(availableNow=True).start()
            q.awaitTermination()
    assert sorted(r["i"] for r in spark.read.schema("v string, window_start timestamp, i int, q double").parquet(str(tmp_path / "w")).collect()) == [1, 4]
    assert [(r["hits"], r["best_sim"]) for r in spark.read.schema("v string, start_ts timestamp, end_ts timestamp, hits long, best_sim double").parquet(str(tmp_path / "s")).collect()] == [(8, 9.0)]


def test_chunk_batches_resume(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        flows.chunk_batches(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, epoch: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 10


def test_numbered_equals_ranked(spark):
    df = spark.range(500).select((F.col("id") % 2 == 0).alias("k"), F.xxhash64("id").alias("v")).repartition(7)
    a, b = (sorted(map(tuple, f(df, ["k"], ["v"]).select("k", "v", F.col("rank").cast("long")).collect())) for f in (O.numbered, O.ranked))
    assert a == b and O.numbered(df.limit(0), ["k"], ["v"]).count() == 0


def test_near_hashes(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, b ^ sum(1 << p for p in rng.sample(range(63), rng.randrange(10)))) for i, b in enumerate(base * 30)]
    h, q = spark.createDataFrame(rows, "i int, h long"), spark.createDataFrame(list(enumerate(base)), "j int, q long")
    want = {(i, j) for i, x in rows for j, y in enumerate(base) if (x ^ y).bit_count() <= 7}
    assert {(r["i"], r["j"]) for r in J.near_hashes(h, q, "h", "q", 7).collect()} == want


def test_decision_lines_round_as_sql(spark, duck):
    """A product that misses a half by its last bits prints as the half, as in the SQL; NaN, huge and missing numbers print too."""
    from prismlane.plans.queries_tables import _n

    rows = [(c, n, p, (c + n) * p) for c, n, p in ((3.2, 4.3, 0.71), (5.27, 4.2, 0.5), (6.75, 4.5, 0.7), (4.0, 4.5, 0.69), (3.0, 4.0, 0.125), (-3.0, -4.0, 0.125), (-0.001, 0.0, 1.0), (1.0, 1.0, 1e-9))]
    df = spark.createDataFrame(rows, "clip double, nima double, piq double, overall double")
    lines = sinks.decision_lines(df.select(F.lit("selected").alias("status"), F.lit("v").alias("video"), F.lit(1).alias("frame"), F.lit(None).cast("double").alias("ts"), "*", F.lit(None).cast("string").alias("reason")))
    got = [dict(x.split("=") for x in r["value"].split("\t")[2:]) for r in lines.collect()]
    want = duck.sql(f"select {', '.join(_n.format(c, 2, 'NA') for c in ('clip', 'nima', 'piq', 'overall'))} from (values {', '.join('(' + ', '.join(f'{x!r}::double' for x in r) + ')' for r in rows)}) t(clip, nima, piq, overall)").fetchall()
    assert [tuple(g[c] for c in ("clip", "nima", "piq", "overall")) for g in got] == want
    assert got[0] == {"frame": "1", "ts": "NA", "clip": "3.20", "nima": "4.30", "piq": "0.71", "overall": "5.33", "reason": "NA"}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e30,), (None,)], "x double").select(S.text_number(F.col("x"), 1))
    assert [r[0] for r in odd.collect()] == ["NaN", "Infinity", "1" + "0" * 30 + ".0", "NA"]


def test_decision_lines_of_odd_ids(spark, tmp_path):
    """A document without an id gives a null line, no line with fewer fields; times of ids beyond 2^51 print all their digits, as in the SQL."""
    import duckdb

    from prismlane.plans import catalogue

    ids = [None, 0, 7, *[s * (2**k + i) for k in (41, 43, 50, 51, 52, 53, 54, 55, 60, 62) for i in range(8) for s in (1, -1)], 2**63 - 1, -(2**63)]
    con = duckdb.connect()
    for name, df in (
        ("documents", spark.createDataFrame([(x, 14 * i if i % 5 else None) for i, x in enumerate(ids)], "doc_id long, n_chars long")),
        ("labels", spark.createDataFrame([(x, 1 if i % 3 else None) for i, x in enumerate(ids) if i % 2], "doc_id long, quality int")),
    ):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [r["value"] for r in catalogue.QUERIES["decision_lines"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((r[0] for r in con.sql(catalogue.ORACLE_SQL["decision_lines"]).fetchall()), key=repr)
    assert got.count(None) == 1
    assert all(len(x.split("\t")) == 9 for x in got if x is not None)
