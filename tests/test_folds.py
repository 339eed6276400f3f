"""Sequential folds against plain models, and their properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismlane.operators import folds as D
from prismlane.operators import mis as M


def unit(rng, n, dim=6):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 40), st.floats(0.05, 1.2))
def test_keep_first(seed, n, thr):
    v = unit(np.random.default_rng(seed), n)
    kept = D.keep_first(v, thr)
    for a in kept:
        assert all(1 - v[a] @ v[b] >= thr - 1e-12 for b in kept if b < a)
    for i in set(range(n)) - set(kept):
        assert any(1 - v[i] @ v[k] < thr for k in kept if k < i)


def test_keep_first_edges():
    assert D.keep_first(np.zeros((0, 3)), 0.5) == []
    v = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert D.keep_first(v, 0) == [0, 1, 2]
    assert D.keep_first(v, 0.5) == [0, 2]
    assert D.keep_first(v, 0.5, 1) == [0]
    assert D.keep_first(v, 1.0) == [0, 2]  # exactly at the threshold is no duplicate


def test_replacement_prefers_smiles():
    v = np.array([[1.0, 0], [1.0, 0], [1.0, 0]])
    assert D.with_replacement(v, [(False, 9), (True, 1), (False, 10)], 0.1) == ([1], {0: "replaced", 2: "dedup"})
    assert D.with_replacement(v, [(False, 9), (True, 1), (False, 10)], 0.1, smiles=False)[0] == [2]
    assert D.with_replacement(v, [(True, 1), (True, 1), (True, 1)], 0.1)[0] == [0]


def test_across_chunks_ghosts():
    a, b = np.array([1.0, 0.0]), np.array([0.8, 0.6])
    v = np.array([a, b, a])  # b replaces a inside chunk 0; a comes again in chunk 1
    marks = [(False, 1), (True, 1), (False, 1)]
    assert D.across_chunks(v, marks, [0, 0, 1], 0.21)[0] == [1]
    near = np.array([a, b, [0.96, -0.28]])
    assert D.across_chunks(near, marks, [0, 0, 1], 0.21, ghosts=False)[0] == [1, 2]
    assert D.across_chunks(near, marks, [0, 0, 1], 0.21, ghosts=True)[0] == [1]


def test_group_start_up():
    a, b = [1.0, 0.0], [0.0, 1.0]
    group, best = D.threshold_groups(np.array([a, a, a, b, b, a]), np.array([1, 1, 1, 1, 1, 1.0]), 0.5)
    assert group[:3] == [0, 1, 1] and group[3] == 2 and best[0] == 0


def test_clusters_threshold_is_inclusive():
    v = np.array([[1.0, 0], [0.6, 0.8], [0.0, 1.0]])
    assert D.centroid_clusters(v, 0.6)[:2] == [0, 0]
    assert D.centroid_clusters(v, 0.61)[:2] == [0, 1]
    assert D.centroid_clusters(np.zeros((0, 2)), 0.5) == []


def test_seen_lately_window():
    v = unit(np.random.default_rng(1), 1).repeat(3, axis=0)
    assert D.seen_lately([0, 0, 0], v, np.array([0.0, 5.0, 10.1])) == [0, 2]
    assert D.seen_lately([0, 127, 0], -v * np.array([[1], [-1], [1]]), np.array([0.0, 1.0, 2.0]), method="hash") == [0, 1]


def test_novel_adaptive_track_smooth():
    assert D.novel_images([0, 0, 2**20 - 1], np.array([[1.0, 0], [0, 1.0], [0, 1.0]])) == [0, 2]
    assert D.adaptive_samples(list(range(12)), [i == 0 for i in range(12)], 5, 2, 2) == [0, 2, 4, 9]
    assert D.linked_boxes([0, 1, 2, 9], [(0, 0, 10, 10), (1, 1, 10, 10), (50, 50, 5, 5), (1, 1, 10, 10)]) == [True, True, False, False]
    assert D.smoothed([1.0, 2.0]) == [1.0, pytest.approx(1.35)]


def test_mis_equals_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 3, k, k, [float(x) for x in v]) for k, v in enumerate(unit(rng, 60))]
    df = spark.createDataFrame(rows, "video int, id int, rank int, v array<double>")
    fold = {tuple(r) for r in D.greedy_dedup(df, "video", "v", [("rank", True)], 0.6, "id").collect()}
    rounds = {tuple(r) for r in M.greedy_independent(df, M.similarity_edges(df, "video", "id", "rank", "v", 0.6), "video", "id").collect()}
    assert fold == rounds
    empty = df.where(F.lit(False))
    assert M.greedy_independent(empty, M.similarity_edges(empty, "video", "id", "rank", "v", 0.6), "video", "id").count() == 0
    assert D.greedy_dedup(empty, "video", "v", [("rank", True)], 0.6, "id").count() == 0


def test_global_registry_takes_all_survivors(spark):
    """Every frame enters the per-video pass, and every survivor the registry; against plain loops."""
    from prismlane.plans import queries_folds as Q
    from prismlane.sources.tables import frames

    from .conftest import SMALL

    rows = [r.asDict() | {"v": np.array(r["embedding"], dtype=float)} for r in frames(spark, SMALL).collect()]
    left: dict = {}
    for r in sorted(rows, key=lambda r: (-r["aesthetic"], -r["tech_score"], r["frame_index"])):
        if all(1 - r["v"] @ k["v"] >= Q.DEDUP for k in left.setdefault(r["video_id"], [])):
            left[r["video_id"]].append(r)
    slots, want = [], {}
    for r in sorted((r for v in left.values() for r in v), key=lambda r: (r["video_id"], r["timestamp_sec"], r["frame_index"])):
        r["id"] = r["video_id"] * 1000000 + r["frame_index"]
        j = max(range(len(slots)), key=lambda k: slots[k]["v"] @ r["v"], default=None)
        if j is None or 1 - slots[j]["v"] @ r["v"] >= Q.REPLACE:
            slots.append(r)
        elif (r["has_smile"] and not slots[j]["has_smile"]) or (r["has_smile"] == slots[j]["has_smile"] and r["aesthetic"] > slots[j]["aesthetic"]):
            want[slots[j]["id"]], slots[j] = "replaced", r
        else:
            want[r["id"]] = "dedup"
    want |= {r["id"]: "kept" for r in slots}
    assert {r["frame_id"]: r["status"] for r in Q.global_dedup(spark, SMALL).collect()} == want
    assert any(r["aesthetic"] < 4 for v in left.values() for r in v) and len(want) == sum(map(len, left.values()))
