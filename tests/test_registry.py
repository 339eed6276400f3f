"""The registry in rounds against the sequential fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlane.operators import folds as D
from prismlane.operators import registry as R
from prismlane.plans import queries_folds as Q

from .conftest import SMALL
from .test_folds import unit

KIND = "place long, id long, smile boolean, q double, v array<double>"


def plain(rows, threshold):
    rows = sorted(rows)
    kept, gone = D.with_replacement(np.array([r[4] for r in rows]), [(bool(r[2]), r[3]) for r in rows], threshold)
    return {r[1]: gone.get(i, "kept") for i, r in enumerate(rows)}


def in_rounds(spark, rows, threshold, deal=64):
    df = spark.createDataFrame(rows, KIND).repartition(deal) if rows else spark.createDataFrame([], KIND)
    out = R.one_registry(df, "v", [("place", True), ("id", True)], "smile", "q", threshold, "id").collect()
    assert len(out) == len(rows)
    return {r["id"]: r["status"] for r in out}


@pytest.mark.parametrize("seed, dim, threshold", [(0, 4, 0.3), (1, 8, 0.7), (2, 16, 0.2), (3, 3, 1.2)])
def test_equals_fold(spark, monkeypatch, seed, dim, threshold):
    """Parts and ranges of a few rows, so that slots go from range to range and rounds repeat; places and vectors repeat too."""
    monkeypatch.setattr(R, "FIRST", 16)
    monkeypatch.setattr(R, "PART", 100)
    rng = np.random.default_rng(seed)
    some = unit(rng, 250, dim)
    rows = [(int(rng.integers(0, 300)), 1000 - k, bool(rng.random() < 0.3), float(rng.integers(0, 40)), [float(x) for x in some[rng.integers(0, 250)]]) for k in range(900)]
    rounds = []
    real = R.changers
    monkeypatch.setattr(R, "changers", lambda rows, known: rounds.append(len(known.pos)) or real(rows, known))
    assert in_rounds(spark, rows, threshold) == plain(rows, threshold)
    assert len(rounds) > 3 and len(set(rounds)) > 1


def test_edges(spark):
    one = [1.0, 0.0]
    assert in_rounds(spark, [], 0.5) == {}
    assert in_rounds(spark, [(0, 1, False, 1.0, one), (0, 2, False, 1.0, one)], 0.0) == {1: "kept", 2: "kept"}
    rows = [(k, k, None if k % 2 else False, [1.0, 3.0, None, 2.0, 9.0][k], one) for k in range(5)]
    assert in_rounds(spark, rows, 0.5) == {0: "replaced", 1: "replaced", 2: "dedup", 3: "dedup", 4: "kept"}
    apart = [(k, k, False, 1.0, [float(i == k) for i in range(90)]) for k in range(90)]
    assert set(in_rounds(spark, apart, 1.0).values()) == {"kept"}  # exactly at the threshold is no duplicate
    assert in_rounds(spark, [(0, 1, False, 1.0, one), (1, 2, False, 0.0, [0.0, 1.0]), (2, 3, False, 5.0, [0.6, 0.6])], 0.5) == {1: "replaced", 2: "kept", 3: "kept"}  # the first of equal slots
    with pytest.raises(Exception, match="one length"):
        in_rounds(spark, [(0, 1, False, 1.0, one), (1, 2, False, 1.0, None)], 0.5, 1)


def test_changers_known_elsewhere(spark):
    """A task also follows the known changers of other tasks that stand between its rows."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    known = R.Changers(0.5)
    assert known.add(np.array([0, 2]), np.array([a, b]), np.array([False, False]), np.array([1.0, 1.0])) == 0
    assert known.add(np.array([2]), np.array([b]), np.array([False]), np.array([1.0])) is None
    rows = spark.createDataFrame([(1, a, False, 1.0), (3, b, False, 1.0), (4, b, True, 0.0), (5, b, True, 0.0)], "pos_ long, vec_ array<double>, smile_ boolean, quality_ double").coalesce(1)
    assert [r["pos_"] for r in R.changers(rows, known).collect()] == [4]


def test_global_dedup_has_no_group(spark):
    """No task gets all survivors: before, one group of one key did, which took more than an executor's memory."""
    df = Q.global_dedup(spark, SMALL)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.where(F.col("status").isNull()).count() == 0
