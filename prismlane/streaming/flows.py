"""Incremental forms: windows, sessions and running state over streams of frames or hits."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def best_per_window(stream: DataFrame, key: str, ts: str, index: str, score: str, width: str, late: str = "10 seconds") -> DataFrame:
    """The first best frame of each tumbling window, emitted when the watermark closes it."""
    agg = F.max_by(F.struct(index, score), F.struct(F.col(score), -F.col(index))).alias("b")
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(agg).select(key, F.col("w.start").alias("window_start"), "b.*")


def sessions(stream: DataFrame, key: str, ts: str, sim: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """Hits no further apart than `gap` as one session."""
    s = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("hits"), F.max(sim).alias("best_sim"))
    return s.select(key, F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "hits", "best_sim")


def _timeout(event_time: str | None) -> str:
    return GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout


def _expire(state: GroupState, rows: pd.DataFrame, event_time: str | None, after: float) -> None:
    """The state of a key goes when the watermark is `after` seconds beyond the key's last row."""
    if event_time:
        last = int((rows[event_time].max().timestamp() + after) * 1000) + 1
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))


def lately_unseen(stream: DataFrame, key: str, ts: str, vec: str, ids: str, window: float, least: float, schema: str, event_time: str | None = None) -> DataFrame:
    """Rows without a kept one of their key within `window` seconds whose vector is alike; state holds only that window.

    With an event_time (a column of the stream that has a watermark) a key's state goes once the watermark is a window beyond its
    last row. Without one it stays: there is no time by which it could be dropped.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, vectors = state.get if state.exists else ([], [])
        times, vectors = list(times), [list(v) for v in vectors]
        out = []
        rows = pd.concat(list(batches))
        for t, v, i in rows.sort_values([ts, ids])[[ts, vec, ids]].itertuples(index=False, name=None):
            live = [j for j, x in enumerate(times) if t - x <= window]
            times, vectors = [times[j] for j in live], [vectors[j] for j in live]
            if not vectors or not (np.asarray(vectors) @ np.asarray(v, dtype=float) >= least).any():
                times.append(float(t))
                vectors.append([float(x) for x in v])
                out.append((k[0], i))
        state.update((times, vectors))
        _expire(state, rows, event_time, window)
        yield pd.DataFrame(out, columns=[key, ids])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "times array<double>, vectors array<array<double>>", "append", _timeout(event_time))


def hit_streaks(stream: DataFrame, key: str, index: str, match: str, n: int, schema: str, event_time: str | None = None, idle: float = 7 * 86400.0) -> DataFrame:
    """Matches from the n-th of a run on; the run's length is the state. With an event_time (a column that has a watermark) it goes
    once the watermark is `idle` seconds beyond the key's last row."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(batches))
        for i, m in rows.sort_values(index)[[index, match]].itertuples(index=False, name=None):
            run = run + 1 if m else 0
            if run >= n:
                out.append((k[0], i))
        state.update((run,))
        _expire(state, rows, event_time, idle)
        yield pd.DataFrame(out, columns=[key, index])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "run long", "append", _timeout(event_time))


def chunk_batches(stream: DataFrame, process, checkpoint: str):
    """Each micro-batch is a chunk, given to process(df, epoch); resumes from the checkpoint."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
