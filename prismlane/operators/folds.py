"""Order-dependent selections as NumPy folds over one video (or scope) at a time.

The group is one video, which bounds it; rows come in the order given, with a total tiebreak. All arithmetic is in doubles. A
fold never sees two videos, so videos spread over tasks. Where the rows of all videos form one sequence (global_dedup)
operators.registry gives the rows of with_replacement without a group.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _vectors(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf[col]]) if len(pdf) else np.zeros((0, 1))


def apply_fold(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fold over each group's rows in the order of (column, ascending)."""
    cols, ups = [c for c, _ in order], [a for _, a in order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(cols, ascending=ups, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def keep_first(vectors: np.ndarray, threshold: float, most: int | None = None) -> list[int]:
    """Positions kept: those at `threshold` or further from all kept before; all if threshold <= 0."""
    kept: list[int] = []
    mat = np.empty_like(vectors)
    for i, v in enumerate(vectors):
        if most is not None and len(kept) >= most:
            break
        if threshold <= 0 or not kept or not ((1.0 - mat[: len(kept)] @ v) < threshold).any():
            mat[len(kept)] = v
            kept.append(i)
    return kept


def prefers(new: tuple[bool, float], old: tuple[bool, float], smiles: bool = True) -> bool:
    """Whether (smile, quality) takes the place of another: a smile beats none, else the strictly higher quality."""
    if smiles and new[0] != old[0]:
        return new[0]
    return new[1] > old[1]


def with_replacement(vectors: np.ndarray, marks: list[tuple[bool, float]], threshold: float, smiles: bool = True) -> tuple[list[int], dict[int, str]]:
    """Positions held by the slots at the end, and why others left (dedup or replaced). A slot's vector changes with its holder."""
    slots: list[int] = []
    gone: dict[int, str] = {}
    mat = np.empty_like(vectors)
    for i, v in enumerate(vectors):
        if threshold > 0 and slots:
            sims = mat[: len(slots)] @ v
            j = int(np.argmax(sims))
            if 1.0 - sims[j] < threshold:
                if prefers(marks[i], marks[slots[j]], smiles):
                    gone[slots[j]] = "replaced"
                    slots[j], mat[j] = i, v
                else:
                    gone[i] = "dedup"
                continue
        mat[len(slots)] = v
        slots.append(i)
    return slots, gone


def across_chunks(vectors: np.ndarray, marks: list[tuple[bool, float]], chunks: list[int], threshold: float, ghosts: bool = False) -> tuple[list[int], list[int]]:
    """Positions kept and removed: near any vector of an earlier chunk goes; within the chunk the replacement rule holds.

    ghosts=True leaves vectors that were replaced inside their chunk in the index, as the original does.
    """
    index: list[np.ndarray] = []
    kept, removed = [], []
    for chunk in dict.fromkeys(chunks):
        slots: list[int] = []
        new: list[np.ndarray] = []
        for i in [k for k, c in enumerate(chunks) if c == chunk]:
            v = vectors[i]
            if threshold > 0 and index and 1.0 - float((np.stack(index) @ v).max()) < threshold:
                removed.append(i)
                continue
            if threshold > 0 and slots:
                sims = vectors[slots] @ v
                j = int(np.argmax(sims))
                if 1.0 - sims[j] < threshold:
                    if prefers(marks[i], marks[slots[j]]):
                        removed.append(slots[j])
                        slots[j] = i
                        new.append(v)
                    else:
                        removed.append(i)
                    continue
            slots.append(i)
            new.append(v)
        index += new if ghosts else [vectors[i] for i in slots]
        kept += slots
    return kept, removed


def seen_lately(hashes: list[int], vectors: np.ndarray, times: np.ndarray, window: float = 5.0, bits: int = 6, least: float = 0.995, method: str = "both") -> list[int]:
    """Positions kept: those without a kept one within `window` seconds that is alike by hash or vector."""
    kept: list[int] = []
    for i, t in enumerate(times):
        near = [k for k in reversed(kept) if t - times[k] <= window]
        alike = method in ("hash", "both") and any((hashes[k] ^ hashes[i]).bit_count() <= bits for k in near)
        if not alike and method in ("embedding", "both") and near:
            alike = bool((vectors[near] @ vectors[i] >= least).any())
        if not alike:
            kept.append(i)
    return kept


def threshold_groups(vectors: np.ndarray, quality: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """Group number of each row, and each group's best row. A row is held against the best row of the group before the open one."""
    group, best = [], []
    anchor = None
    for i, v in enumerate(vectors):
        if anchor is None or 1.0 - float(anchor @ v) > threshold:
            if best:
                anchor = vectors[best[-1]]
            best.append(i)
        elif quality[i] > quality[best[-1]]:
            best[-1] = i
        group.append(len(best) - 1)
    return group, best


def centroid_clusters(vectors: np.ndarray, least: float) -> list[int]:
    """Cluster of each row: the first of the nearest centroids if near enough, else a new one; centroids stay of length one."""
    cents = np.empty_like(vectors)
    size: list[int] = []
    out = []
    for v in vectors:
        j = -1
        if size:
            sims = cents[: len(size)] @ v
            j = int(np.argmax(sims))
            if sims[j] < least:
                j = -1
        if j < 0:
            j = len(size)
            cents[j] = v
            size.append(1)
        else:
            c = cents[j] * size[j] + v
            cents[j] = c / max(1e-9, float(np.sqrt((c * c).sum())))
            size[j] += 1
        out.append(j)
    return out


def novel_images(hashes: list[int], vectors: np.ndarray, bits: int = 6, distance: float = 0.10) -> list[int]:
    """Positions that differ from all recorded ones by more than `bits` and more than `distance`; only those are recorded."""
    kept: list[int] = []
    for i, h in enumerate(hashes):
        if any((h ^ hashes[k]).bit_count() <= bits for k in kept):
            continue
        if kept and float((1.0 - vectors[kept] @ vectors[i]).min()) <= distance:
            continue
        kept.append(i)
    return kept


def adaptive_samples(index: list[int], hit: list[bool], step: int, boost_step: int, boost: int) -> list[int]:
    """Frames sampled when a hit shortens the step for the next `boost` samples."""
    out, following, left = [], None, 0
    for i, h in zip(index, hit):
        if following is not None and i < following:
            continue
        out.append(i)
        if h:
            left = boost
        following = i + (boost_step if left > 0 else step)
        left = max(0, left - 1)
    return out


def iou(a, b) -> float:
    iw = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    ih = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    inter = iw * ih
    return inter / (a[2] * a[3] + b[2] * b[3] - inter + 1e-9)


def linked_boxes(times: list[float], boxes: list[tuple], least: float = 0.3, gap: float = 2.0) -> list[bool]:
    """Which boxes continue the target's track: overlap with its last box, no longer than `gap` ago; the first starts it."""
    out, last, seen = [], None, None
    for t, box in zip(times, boxes):
        ok = last is None or (t - seen <= gap and iou(last, box) >= least)
        if ok:
            last, seen = box, t
        out.append(ok)
    return out


def smooth_boxes(df: DataFrame, key: str, order: str, box: list[str], ids: str, alpha: float = 0.35) -> DataFrame:
    """(key, ids, box): each video's boxes in time order, every side a running mean that moves by alpha."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[key, ids]].assign(**{c: smoothed([float(v) for v in pdf[c]], alpha) for c in box})

    return apply_fold(df.select(*dict.fromkeys([key, ids, order, *box])), [key], [(order, True), (ids, True)], fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, " + ", ".join(f"{c} double" for c in box))


def smoothed(values: list[float], alpha: float = 0.35) -> list[float]:
    out: list[float] = []
    for v in values:
        out.append(v if not out else alpha * v + (1 - alpha) * out[-1])
    return out


# ---- the folds on DataFrames


def greedy_dedup(df: DataFrame, key: str, vec: str, order: list[tuple[str, bool]], threshold: float, ids: str, budget: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows kept by keep_first, with the columns `carry`; with `budget` at most that many (a column constant in the group)."""
    cols = list(dict.fromkeys([key, ids, *carry]))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        most = int(pdf[budget].iloc[0]) if budget else None
        return pdf.iloc[keep_first(_vectors(pdf, vec), threshold, most)][cols]

    return apply_fold(df.select(*dict.fromkeys([*cols, vec, *(c for c, _ in order), *([budget] if budget else [])])), [key], order, fold, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols))


def dedup_with_replacement(df: DataFrame, key: str, vec: str, order: list[tuple[str, bool]], smile: str, quality: str, threshold: float, ids: str) -> DataFrame:
    """All rows with status kept, replaced or dedup."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        _, gone = with_replacement(_vectors(pdf, vec), list(zip(pdf[smile].astype(bool), pdf[quality])), threshold)
        return pdf[[key, ids]].assign(status=[gone.get(i, "kept") for i in range(len(pdf))])

    return apply_fold(df.select(*dict.fromkeys([key, ids, vec, smile, quality, *(c for c, _ in order)])), [key], order, fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, status string")


def final_dedup(df: DataFrame, key: str, chunk: str, vec: str, order: list[tuple[str, bool]], smile: str, quality: str, threshold: float, ids: str, ghosts: bool = False) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, _ = across_chunks(_vectors(pdf, vec), list(zip(pdf[smile].astype(bool), pdf[quality])), list(pdf[chunk]), threshold, ghosts)
        return pdf[[key, ids]].assign(kept=[i in set(kept) for i in range(len(pdf))])

    return apply_fold(df.select(*dict.fromkeys([key, ids, chunk, vec, smile, quality, *(c for c, _ in order)])), [key], [(chunk, True), *order], fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, kept boolean")


def windowed_dedup(df: DataFrame, key: str, ts: str, face_hash: str, vec: str, ids: str, window: float = 5.0, bits: int = 6, least: float = 0.995, method: str = "both") -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = seen_lately([int(h) & (2**64 - 1) for h in pdf[face_hash]], _vectors(pdf, vec), pdf[ts].to_numpy(), window, bits, least, method)
        return pdf.iloc[kept][[key, ids]]

    return apply_fold(df.select(key, ids, ts, face_hash, vec), [key], [(ts, True), (ids, True)], fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}")


def grouped(df: DataFrame, key: str, vec: str, order: list[tuple[str, bool]], quality: str, threshold: float, ids: str) -> DataFrame:
    """Each row with its group number and whether it is the group's representative."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        group, best = threshold_groups(_vectors(pdf, vec), pdf[quality].to_numpy(), threshold)
        return pdf[[key, ids]].assign(group_id=group, is_representative=[i in set(best) for i in range(len(pdf))])

    return apply_fold(df.select(*dict.fromkeys([key, ids, vec, quality, *(c for c, _ in order)])), [key], order, fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, group_id long, is_representative boolean")


def clustered(df: DataFrame, key: str, vec: str, order: list[tuple[str, bool]], least: float, ids: str) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[key, ids]].assign(cluster_id=centroid_clusters(_vectors(pdf, vec), least))

    return apply_fold(df.select(*dict.fromkeys([key, ids, vec, *(c for c, _ in order)])), [key], order, fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, cluster_id long")


def novel(df: DataFrame, key: str, image_hash: str, vec: str, order: list[tuple[str, bool]], ids: str, bits: int = 6, distance: float = 0.10) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[novel_images([int(h) & (2**64 - 1) for h in pdf[image_hash]], _vectors(pdf, vec), bits, distance)][[key, ids]]

    return apply_fold(df.select(*dict.fromkeys([key, ids, image_hash, vec, *(c for c, _ in order)])), [key], order, fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}")


def adaptively_sampled(df: DataFrame, key: str, index: str, hit: str, step: int, boost_step: int, boost: int) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, index)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[0], index: adaptive_samples(list(pdf[index]), list(pdf[hit]), step, boost_step, boost)})

    return apply_fold(df.select(key, index, hit), [key], [(index, True)], fold, f"{key} {kinds[key]}, {index} {kinds[index]}")


def tracked(df: DataFrame, key: str, ts: str, box: list[str], ids: str, least: float = 0.3, gap: float = 2.0) -> DataFrame:
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, ids)}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[key, ids]].assign(linked=linked_boxes(list(pdf[ts]), list(pdf[box].itertuples(index=False, name=None)), least, gap))

    return apply_fold(df.select(key, ids, ts, *box), [key], [(ts, True), (ids, True)], fold, f"{key} {kinds[key]}, {ids} {kinds[ids]}, linked boolean")
