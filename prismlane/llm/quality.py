"""Quality classifier: a sparse ensemble of rules over text statistics, scored by Spark columns.

Statistics of the whole text are computed in NumPy over Arrow batches. Small boosted trees are grown on a sample of about
SAMPLE labelled rows (by a hash of doc_id, among rows whose crc32(doc_id) mod 4 is not 2); every path from a root is a rule, a
conjunction of thresholds. A lasso logistic regression weighs the rules and leaves few; those are compiled into one Column
expression. labels, lang, source and doc_id are no inputs of a score. A null text counts as empty; long texts are read whole. Without
labels of both kinds every score is the share of label 1 (0.5 without labels). An id with several texts is learned from its least, one
labelled 0 and 1 counts for both. Each row is scored alone; repeated rows get equal scores; a score on the cut is accepted. An empty
table gives no rows; other columns pass through, clashing names get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repetition, store, textkit as tk
from .langid import bucket

store.by_value(tk.__name__)
store.by_value(repetition.__name__)
store.by_value(__name__)

SAMPLE, TREES, DEPTH, BINS, RATE, SEED = 20000, 40, 3, 48, 0.3, 11
LASSO, ROUNDS, LEAST_ROWS, CUT = 0.002, 400, 10, 0.7
FEATURES = [
    "f_words", "f_word_chars", "f_symbols", "f_upper", "f_digits", "f_punct", "f_bang", "f_pipe", "f_white", "f_distinct", "f_next_same",
    "f_top_gap", "f_line_words", "f_line_end", "f_dup_lines", "f_dup_3", "f_dup_5", "f_dup_10", "f_caps_words", "f_sym_words",
]


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UP, _LOW = _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flag("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _BANG, _PIPE, _END = _flag("0123456789"), _flag("!"), _flag("|"), _flag(".!?:;\"')")
_PUNCT = _flag("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SYM = _flag("#*$%&|<>@^~=+{}[]\\/_")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    start, end, row = tk.words(data, off)
    count = np.bincount(row, minlength=n)
    many = np.maximum(count, 1)
    total = np.maximum(np.diff(off), 1)
    in_words = np.maximum(np.bincount(row, weights=end - start, minlength=n), 1)
    share = lambda table: tk.per_row(table[data], off) / in_words
    hashes = tk.segment_hash(data, start, end, lower=True)
    by_word = lambda flags: np.bincount(row[flags], minlength=n) / many
    out = {"f_words": np.log1p(count), "f_word_chars": in_words / many, "f_symbols": share(_SYM), "f_digits": share(_DIGIT), "f_punct": share(_PUNCT)}
    upper, lower = tk.per_row(_UP[data], off), tk.per_row(_LOW[data], off)
    out["f_upper"] = upper / np.maximum(upper + lower, 1)
    out["f_bang"], out["f_pipe"] = tk.per_row(_BANG[data], off) / many, tk.per_row(_PIPE[data], off) / many
    out["f_white"] = 1 - in_words / total
    _, later = tk.repeated(tk.salted(hashes, row))
    out["f_distinct"] = 1 - by_word(later)
    same = np.zeros(len(row), dtype=bool)
    if len(row):
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out["f_next_same"] = by_word(same)
    out["f_top_gap"] = out["f_distinct"] * np.sqrt(many)
    first, last = data[start] if len(start) else np.zeros(0, np.uint8), data[end - 1] if len(end) else np.zeros(0, np.uint8)
    second = data[np.minimum(start + 1, end - 1)] if len(start) else np.zeros(0, np.uint8)
    out["f_caps_words"] = by_word(_UP[first] & _UP[second] & (end - start > 1))
    out["f_sym_words"] = by_word(_SYM[last])
    a, b, lrow = tk.lines(data, off)
    has = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, lrow = a[has], b[has], lrow[has]
    n_lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    out["f_line_words"] = count / n_lines
    out["f_line_end"] = np.bincount(lrow[_END[data[b - 1]]] if len(b) else lrow, minlength=n) / n_lines
    _, later = tk.repeated(tk.salted(tk.segment_hash(data, a, b), lrow))
    out["f_dup_lines"] = np.bincount(lrow[later], minlength=n) / n_lines
    for k in (3, 5, 10):
        at, value = tk.windows(hashes, row, k)
        twice, _ = tk.repeated(tk.salted(value, row[at]))
        out[f"f_dup_{k}"] = by_word(tk.covered(at[twice], k, len(row)))
    return np.column_stack([out[f] for f in FEATURES])


def with_features(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """df with the statistics added, and their column names."""
    names = [store.free_name(f, df.columns) for f in FEATURES]

    def run(batches):
        for batch in batches:
            for i, j, data, off in tk.text_slices(batch, text):
                x = features(data, off)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1]))], names=[*batch.schema.names, *names])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{f}` double" for f in names])
    return df.mapInArrow(run, schema), names


def grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, rng) -> list[tuple]:
    """The paths of one tree over a half of the rows: tuples of (feature, cut, above)."""
    paths: list[tuple] = []
    rows = np.flatnonzero(rng.random(len(x)) < 0.5)

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return
        best, r = (1e-9, None, None), residual[rows]
        base = r.sum() ** 2 / len(rows)
        for f in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
            if not len(cuts[f]):
                continue
            size = np.cumsum(np.bincount(bins[rows, f], minlength=len(cuts[f]) + 1))[:-1]
            left = np.cumsum(np.bincount(bins[rows, f], weights=r, minlength=len(cuts[f]) + 1))[:-1]
            ok = (size >= LEAST_ROWS) & (len(rows) - size >= LEAST_ROWS)
            if ok.any():
                gain = np.where(ok, left**2 / np.maximum(size, 1) + (r.sum() - left) ** 2 / np.maximum(len(rows) - size, 1) - base, 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is not None:
            f, k = int(best[1]), best[2]
            low = bins[rows, f] <= k
            split(rows[low], (*path, (f, float(cuts[f][k]), False)))
            split(rows[~low], (*path, (f, float(cuts[f][k]), True)))

    split(rows, ())
    return paths


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, cut, above in path:
        out &= (x[:, f] > cut) == above
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and weighted rules."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p))), []
    rng = np.random.default_rng(SEED)
    cuts, bins = [], np.zeros(x.shape, dtype=np.int64)
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        q = np.unique(np.concatenate([q, [0.0]])) if x[:, f].min() <= 0 else q
        q = q[q < x[:, f].max()]
        cuts.append(q)
        bins[:, f] = np.searchsorted(q, x[:, f], side="left")  # bin k holds values up to cut k
    score, rules = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        for path in grow(x, y - p, cuts, bins, rng):
            mark = holds(x, path)
            rules.setdefault(tuple(sorted(path)), None)
            if len(path) == DEPTH or mark.sum() < 2 * LEAST_ROWS:
                h = (p * (1 - p))[mark].sum() + 1.0
                score[mark] += RATE * (y - p)[mark].sum() / h
    paths, seen = [], set()
    for path in rules:
        mark = holds(x, path)
        key = mark.tobytes()
        if key not in seen and LEAST_ROWS <= mark.sum() <= len(y) - LEAST_ROWS:
            seen.add(key)
            paths.append((path, mark))
    if not paths:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    a = np.column_stack([m for _, m in paths]).astype(np.float32)
    mean = a.mean(axis=0)
    a -= mean
    w, b, v, vb, t = np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(a.shape[1]), 0.0, 1.0
    vb, step = b, 4.0 / max(1e-6, float(np.linalg.eigvalsh((a.T @ a).astype(np.float64) / len(y))[-1]) + 1.0)
    for _ in range(ROUNDS):  # accelerated proximal steps
        g = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + vb))) - y
        nw = v - step * (a.T @ g.astype(np.float32)) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb, nt = vb - step * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b - (w * mean).sum()), [(path, float(x)) for (path, _), x in zip(paths, w) if abs(x) > 1e-6]


def compiled(model: tuple[float, list], names: list[str]) -> Column:
    """The model as a Column over the statistics."""
    z = F.lit(model[0])
    for path, weight in model[1]:
        cond = F.lit(True)
        for f, cut, above in path:
            cond = cond & (F.col(names[f]) > cut if above else F.col(names[f]) <= cut)
        z = z + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list]:
    """Fits on the whole texts of about `sample` labelled documents, or of all of them if there are fewer."""
    mine = labels.where("quality in (0, 1) and doc_id is not null").where(bucket("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("y_")).distinct()
    share = sample / max(1, mine.count())
    mine = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `sample` distinct ids by construction: small enough to send to the texts; repeated ids are summed up before the exchange
    texts = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy("doc_id", "y_").agg(F.min("text").alias("text"))
    rows, names = with_features(texts)
    got = rows.select("y_", *names, F.xxhash64("doc_id").alias("h_")).toPandas().sort_values(["h_", "y_", *names], kind="stable")
    return fit(got[names].to_numpy(dtype=np.float64), got["y_"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics and score for each row of docs; fitted on labels."""
    stats, names = with_features(docs.select("doc_id", "text"))
    return stats.drop("text").withColumn("score", compiled(learn(docs, labels), names))


def quality_filter(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is `cut` or more, all columns as they are."""
    full, names = with_features(docs)
    return full.where(compiled(learn(docs, labels), names) >= cut).drop(*names)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
