"""Benchmark decontamination by latent semantic retrieval.

The vocabulary is that of the whole benchmark: A-Z lower-cased words without ASCII punctuation at their ends. Every text becomes the
sequence of its vocabulary numbers (0 for other words), kept in the shared folder; all later passes read that, not the text.

1. Document frequencies over all passages of WINDOW words.
2. Randomised SVD of the TF-IDF passages A, distributed, in one pass: each task adds up A'(A G) over its passages for a fixed Gaussian G
   (a term's row follows from its hash); sums meet in rounds, by blocks of terms, FAN_IN at a time. The benchmark's own rows Q join as
   A'A + c Q'Q, with QUERY_SHARE of the corpus energy, so its directions are in the basis. The leading RANK right singular vectors come
   from that product by the Nystroem form (Y (G'Y)^-1 Y', eigenvectors of it), on the driver.
3. Candidates: an inverted index holds for each item the fewest rarest terms without one of which it can't pass step 4; passages, at a
   stride of half a window, meet the items that an own term or a neighbour's names. Pairs whose latent vectors have a cosine of
   LEAST_COSINE or more go on. So the work follows the rare terms found, not passages times items.
4. A candidate counts if the longest common subsequence of item and neighbourhood covers LEAST_LCS of the item's words and
   LEAST_KEYS of the IDF weight of its terms are there (LEAST_KEYS of the `answer` words instead, where the benchmark has such a column and it
   isn't null); an item of under SHORT words must be there almost whole.

An item of more than WINDOW words is searched whole and also in pieces of WINDOW words, half a window apart and one at its end, each
with a vector, a subsequence and key terms of its own, so that a contiguous passage counts however long its item is. `lcs` and
`cosine` are then the piece's. Answers are looked for as far around a piece as around its whole item.

Terms on more than COMMON of all passages are left out of the vectors (each item keeps the rarer half of its own); they still count in
the subsequence. Vocabulary, frequencies and basis are of the whole benchmark: 8, 8 and 4 * RANK bytes a distinct word on driver and
workers. Items and pieces are indexed and sent in blocks of about ITEMS, a pass each, with one result whatever their number. item_id
may be of any type that has an order. An item or text that is null or has no words matches nothing; repeated items are one. Every row of
docs gives one row; repeated rows agree; ties between items go to the higher cosine, then the smaller item_id (null last). Empty tables:
no rows, or all rows clean. Other columns of both tables are left alone and not returned. Long texts are read whole, in slices of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkit as tk

store.by_value(tk.__name__)
store.by_value(__name__)

WINDOW, RANK, EXTRA, SEED, QUERY_SHARE, COMMON = 48, 64, 16, 7, 0.5, 0.02
LEAST_COSINE, LEAST_LCS, LEAST_KEYS, SHORT, LEAST_SHORT, KEYS, ITEMS = 0.30, 0.6, 0.6, 8, 0.95, 5, 20000
BLOCK, FAN_IN, TASKS_A_CORE = 256, 16, 4  # terms that are summed together; sums that meet in a task; tasks that make sums
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word; a word of punctuation only keeps it."""
    start, end, row = tk.words(data, off)
    a, b = start.copy(), end.copy()
    live = np.arange(len(a))
    while len(live):
        live = live[(a[live] < b[live]) & _PUNCT[data[np.minimum(a[live], len(data) - 1)]]]
        a[live] += 1
    live = np.flatnonzero(a < b)
    while len(live):
        live = live[_PUNCT[data[b[live] - 1]]]
        b[live] -= 1
    empty = a >= b
    a, b = np.where(empty, start, a), np.where(empty, end, b)
    return tk.segment_hash(data, a, b, lower=True), row


def encode(vocabulary: np.ndarray):
    """Texts to sequences of 1-based places in the sorted vocabulary."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in tk.text_slices(batch):
                hashes, row = terms(data, off)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                ids = np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")), pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "text_hash", "ids"])

    return run


def sequences(batch: pa.RecordBatch, limit: int = 1 << 18):
    """(first row, ids, offsets) over a batch, in slices of about `limit` words."""
    col = batch.column("ids")
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    off = np.concatenate([[0], np.cumsum(size)])
    for i, j in tk.slices(off, limit):
        yield i, np.frombuffer(b"".join(col.slice(i, j - i).to_pylist()), np.uint32).astype(np.int64), off[i : j + 1] - off[i]


def passages(ids: np.ndarray, off: np.ndarray, shift: int, width: int) -> tuple[np.ndarray, ...]:
    """Passage, term and frequency of each vocabulary term, passages cut at shift, shift + WINDOW ... of each text; and row and first word of each passage."""
    n = np.diff(off)
    many = -(-(n + shift) // WINDOW)
    base = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(ids)) - off[row] + shift
    some = np.flatnonzero(ids > 0)
    key = (base[row[some]] + within[some] // WINDOW) * width + ids[some] - 1
    key, tf = np.unique(key, return_counts=True)
    prow = np.repeat(np.arange(len(n)), many)
    return key // width, key % width, tf, prow, (np.arange(base[-1]) - base[prow]) * WINDOW - shift


def vectors(p: np.ndarray, t: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages that have a weighted term (their numbers), where each begins, terms and unit TF-IDF weights."""
    w = (1 + np.log(tf)) * idf[t]
    live = w > 0
    p, t, w = p[live], t[live], w[live].astype(np.float32)
    if not len(p):
        return p, np.zeros(0, np.int64), t, w
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    norm = np.sqrt(np.add.reduceat(w * w, first))
    return p[first], first, t, w / np.repeat(norm, np.diff(np.append(first, len(p))))


def longest_common(item: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; item: term to the bits of its places."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _summed(make, coded: DataFrame, schema: str = "block int, part int, blob binary") -> dict[int, np.ndarray]:
    """Adds up the float64 blobs that make(batches, part) gives for each task, by block, FAN_IN at a time, in as many rounds as it takes."""

    def made(batches):
        from pyspark import TaskContext

        yield from make(batches, TaskContext.get().partitionId())

    def add(key, table):
        total = None
        for x in table.column("blob"):
            v = np.frombuffer(x.as_buffer(), np.float64)
            total = v.copy() if total is None else total + v
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    parts = max(1, TASKS_A_CORE * coded.sparkSession.sparkContext.defaultParallelism)
    sums = coded.coalesce(parts).mapInArrow(made, schema)  # sums are as wide as the vocabulary, so their number follows the machines
    while True:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)")).groupBy("block", "part").applyInArrow(add, schema)
        if parts == 1:
            return {r["block"]: np.frombuffer(r["blob"], np.float64) for r in sums.select("block", "blob").collect()}


class _Sums:
    """A matrix of which only the blocks of BLOCK rows that are touched exist."""

    def __init__(self, columns: int):
        self.columns, self.blocks = columns, {}

    def add(self, rows: np.ndarray, values: np.ndarray) -> None:
        """values to the sorted distinct rows."""
        number = rows // BLOCK
        at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(rows) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(rows))):
            k = int(number[a])
            if k not in self.blocks:
                self.blocks[k] = np.zeros((BLOCK, self.columns))
            self.blocks[k][rows[a:b] - k * BLOCK] += values[a:b]

    def rows(self, part: int) -> pa.RecordBatch:
        keys = sorted(self.blocks)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array([self.blocks[k].tobytes() for k in keys], pa.binary())], names=["block", "part", "blob"])


def _whole(got: dict[int, np.ndarray], width: int, columns: int) -> np.ndarray:
    out = np.zeros((-(-width // BLOCK) * BLOCK, columns))
    for k, v in got.items():
        if k >= 0:
            out[k * BLOCK : (k + 1) * BLOCK] = v.reshape(BLOCK, columns)
    return out[:width]


def frequencies(coded: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """Passages that hold each term, and the number of passages."""

    def make(batches, part):
        df, n = np.zeros(width), 0.0
        for batch in batches:
            for _, ids, off in sequences(batch):
                _, t, _, prow, _ = passages(ids, off, 0, width)
                df += np.bincount(t, minlength=width)
                n += len(prow)
        if n:
            sums = _Sums(1)
            some = np.flatnonzero(df)
            sums.add(some, df[some, None])
            sums.blocks[-1] = np.full(1, n)
            yield sums.rows(part)

    got = _summed(make, coded)
    return _whole(got, width, 1)[:, 0], float(got[-1][0]) if got else 0.0


def gaussians(vocabulary: np.ndarray, rank: int) -> np.ndarray:
    """A row of standard normal numbers for each term, from its hash."""
    draw = tk._spread(vocabulary[:, None] + np.arange(1, 2 * rank + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
    u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return (np.sqrt(-2 * np.log(u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])).astype(np.float32)


def products(first: np.ndarray, t: np.ndarray, w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows (terms, ascending) of A'(A G) that aren't zero, for the sparse rows of A."""
    w = w[:, None]
    y = np.add.reduceat(g[t] * w, first, axis=0)
    y = np.repeat(y, np.diff(np.append(first, len(t))), axis=0) * w
    order = np.argsort(t, kind="stable")
    t = t[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    return t[at], np.add.reduceat(y[order], at, axis=0)


def latent_basis(coded: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, queries) -> np.ndarray:
    """The leading right singular vectors (terms x RANK) of passages and query rows; queries() gives slices (first, terms, weights) of the latter."""
    width, rank = len(idf), min(RANK + EXTRA, len(idf))
    g = gaussians(vocabulary, rank)

    def make(batches, part):
        total = _Sums(rank)
        for batch in batches:
            for _, ids, off in sequences(batch):
                p, t, tf, _, _ = passages(ids, off, 0, width)
                _, first, t, w = vectors(p, t, tf, idf)
                if len(first):
                    total.add(*products(first, t, w, g))
        yield total.rows(part)

    y, q = _whole(_summed(make, coded), width, rank), np.zeros((width, rank))
    for first, t, w in queries():
        rows, values = products(first, t, w, g)
        q[rows] += values
    mass, own = np.linalg.norm(y), np.linalg.norm(q)
    y = (y / mass if mass else y) + QUERY_SHARE * (q / own if own else q)
    return singular_vectors(y, g.astype(np.float64))[:, :RANK].astype(np.float32)


def singular_vectors(y: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Leading eigenvectors of a positive semidefinite M, from y = M g, by the Nystroem form."""
    y = y + 1e-9 * max(np.linalg.norm(y), 1e-300) * g / np.linalg.norm(g)
    values, turn = np.linalg.eigh((g.T @ y + y.T @ g) / 2)
    some = values > 1e-12 * max(values[-1], 1e-300)
    u, _, _ = np.linalg.svd(y @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)
    return u


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), contaminated, kept, item_id, cosine, lcs for each row of docs (null item_id, 0.0 and 0.0
    for clean ones)."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    kind = benchmark.schema["item_id"].dataType
    docs = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    items = _with_pieces(benchmark.select("item_id", "text", answer.alias("answer")).distinct())
    blocks = max(1, -(-items.count() // ITEMS))
    if blocks == 1:
        all_ = _sorted(items)
        of = lambda k: all_
    else:
        items = store.stash(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
        of = lambda k: _sorted(items.where(F.col("block") == k).drop("block"))
    vocabulary = np.zeros(0, np.uint64)
    for k in range(blocks):
        vocabulary = np.union1d(vocabulary, np.concatenate([vocabulary, *(h for r in _hashed(of(k)) for h in (r[1], r[2]) if h is not None)]))
    if not len(vocabulary):
        none = F.lit(None).cast(kind)
        return docs.select("doc_id", "text_hash", F.lit(False).alias("contaminated"), F.lit(True).alias("kept"), none.alias("item_id"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("lcs"))
    width, of_doc = len(vocabulary), docs.schema["doc_id"].dataType.simpleString()
    coded = store.stash(docs.mapInArrow(encode(vocabulary), f"doc_id {of_doc}, text_hash long, ids binary"), "coded")
    df, total = frequencies(coded, width)
    idf = np.log((total + 1) / (df + 1))
    full_idf, wanted = np.maximum(idf, 1e-3), df <= COMMON * total
    for k in range(blocks):  # each item's rarer half has a weight
        for _, h, _, _ in _hashed(of(k)):
            ids = np.unique(np.searchsorted(vocabulary, h))
            wanted[ids[np.argsort(df[ids], kind="stable")[: max(KEYS, len(ids) // 2)]]] = True
    weight = np.where(wanted, full_idf, 0.0)

    def queries():
        for k in range(blocks):
            rows = [np.searchsorted(vocabulary, r[1]) for r in _hashed(of(k))]
            for i in range(0, len(rows), 2048):
                _, first, t, w = _query_rows(rows[i : i + 2048], width, weight)
                if len(first):
                    yield first, t, w

    basis = latent_basis(coded, vocabulary, weight, queries)
    hits = None
    for k in range(blocks):
        rows = _hashed(of(k))
        if rows:
            mine = _against(coded, Index(rows, vocabulary, full_idf, weight, basis), weight, basis, of_doc, kind)
            hits = mine if hits is None else hits.unionByName(mine)
    if blocks > 1:
        hits = hits.where("contaminated").groupBy("doc_id", "text_hash").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("item_id").isNull().alias("n"), "item_id", "lcs")).alias("r"))
        best = hits.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "r.item_id", (-F.col("r.c")).alias("cosine"), "r.lcs")
        rows = docs.select("doc_id", "text_hash")
        hits = rows.join(best, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left").withColumn("contaminated", F.col("hash_").isNotNull())
    return hits.select("doc_id", "text_hash", "contaminated", (~F.col("contaminated")).alias("kept"), "item_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("lcs", F.lit(0.0)).alias("lcs"))


def _with_pieces(items: DataFrame) -> DataFrame:
    """item_id, text, answer, span: items, and the pieces of long ones; span: the words of the whole item."""
    words = F.filter(F.split("text", "[\\x09-\\x0D ]+"), lambda w: w != "")
    known = items.withColumn("words", words).withColumn("span", F.coalesce(F.size("words"), F.lit(0)))
    last = F.col("span") - WINDOW
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(WINDOW // 2)), F.array(last)))
    pieces = known.where(F.col("span") > WINDOW).withColumn("start", F.explode(starts)).withColumn("text", F.array_join(F.slice("words", F.col("start") + 1, WINDOW), " "))
    cols = ["item_id", "text", "answer", "span"]
    return known.select(cols).unionByName(pieces.select(cols))


def _sorted(items: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, *(() if r[0] is None else (r[0],)), r[1] or "", r[2] or ""))


def _hashed(rows: list[tuple]) -> list[tuple]:
    """(item_id, hashes of the words, of the answer's or None, span) of the items that have words."""

    def of(texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        hashes, row = terms(*tk.text_bytes(pa.array([t or "" for t in texts], pa.large_string())))
        return np.split(hashes, np.searchsorted(row, np.arange(1, len(texts))))

    out = zip((r[0] for r in rows), of([r[1] for r in rows]), of([r[2] for r in rows]), rows)
    return [(i, h, a if r[2] else None, r[3]) for i, h, a, r in out if len(h)]


def _query_rows(rows: list[np.ndarray], width: int, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """The items' sparse unit rows, as vectors() gives them."""
    key = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) * width + np.concatenate(rows)
    key, tf = np.unique(key, return_counts=True)
    return vectors(key // width, key % width, tf, weight)


class Index:
    """A block of items as flat arrays: word sequences, key terms and their weights, latent vectors, and an inverted index of the terms
    of which an item needs one at least."""

    def __init__(self, rows: list[tuple], vocabulary: np.ndarray, full_idf: np.ndarray, weight: np.ndarray, basis: np.ndarray):
        width, n = len(vocabulary), len(rows)
        words = [np.searchsorted(vocabulary, h) for _, h, _, _ in rows]
        self.ids, self.width = [r[0] for r in rows], width
        self.words, self.begin = np.concatenate(words).astype(np.uint32), np.concatenate([[0], np.cumsum([len(w) for w in words])])
        size = np.diff(self.begin)
        self.own = np.maximum(WINDOW, size)
        self.reach = np.array([max(o, r[3]) if r[2] is not None else o for o, r in zip(self.own.tolist(), rows)])
        self.target = np.zeros((n, basis.shape[1]), dtype=np.float32)
        for i in range(0, n, 2048):
            q, first, t, w = _query_rows(words[i : i + 2048], width, weight)
            if len(q):
                self.target[i + q] = latent(first, t, w, basis)
        codes, values, enough, posted = [], [], np.zeros(n), []
        for k, (w, (_, _, answer, _)) in enumerate(zip(words, rows)):
            if answer is None:
                t = np.unique(w)
                v = full_idf[t]
                rare = np.argsort(-v, kind="stable")
                need = 1 + int(np.searchsorted(np.cumsum(v[rare]), (1 - LEAST_KEYS) * v.sum() * (1 + 1e-6)))
                posted.append(t[rare[:need]])
            else:
                t, v = np.unique(np.searchsorted(vocabulary, answer), return_counts=True)
                rare = w[np.argsort(-full_idf[w], kind="stable")]
                posted.append(np.unique(rare[: len(w) - int(np.ceil(self.least(len(w)) * len(w) - 1e-9)) + 1]))
            codes.append(k * width + t)
            values.append(v)
            enough[k] = LEAST_KEYS * v.sum()
        self.codes, self.values, self.enough = np.concatenate(codes), np.concatenate(values).astype(np.float64), enough
        term, item = np.concatenate(posted), np.repeat(np.arange(n), [len(x) for x in posted])
        order = np.argsort(term, kind="stable")
        self.item, self.posted, self.at = item[order], *np.unique(term[order], return_index=True)
        self.masks: dict[int, dict[int, int]] = {}

    @staticmethod
    def least(size: int) -> float:
        return LEAST_LCS if size >= SHORT else LEAST_SHORT

    def named(self, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (passage, item) of the inverted index, for terms t of passages p."""
        if not len(self.posted):
            return p[:0], p[:0]
        at = np.minimum(np.searchsorted(self.posted, t), len(self.posted) - 1)
        some = np.flatnonzero(self.posted[at] == t)
        begin = self.at[at[some]]
        n = np.append(self.at, len(self.item))[at[some] + 1] - begin
        first = np.cumsum(n) - n
        return np.repeat(p[some], n), self.item[np.arange(n.sum()) - np.repeat(first - begin, n)]

    def weight_there(self, p: np.ndarray, k: np.ndarray, begin: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The weight of item k's key terms in passage p, for each pair."""
        n = begin[p + 1] - begin[p]
        some = np.flatnonzero(n > 0)
        out = np.zeros(len(p))
        if len(some):
            n = n[some]
            first = np.cumsum(n) - n
            code = np.repeat(k[some] * self.width, n) + term[np.arange(n.sum()) - np.repeat(first - begin[p[some]], n)]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out[some] = np.add.reduceat(np.where(self.codes[at] == code, self.values[at], 0.0), first)
        return out

    def verify(self, k: int, near: np.ndarray, wide: np.ndarray) -> float:
        """The share of item k's words in the longest common subsequence, 0.0 if that or the key terms don't suffice."""
        a, b = np.searchsorted(self.codes, [k * self.width, (k + 1) * self.width])
        if self.values[a:b][np.isin(self.codes[a:b] - k * self.width, wide)].sum() < self.enough[k]:
            return 0.0
        size = int(self.begin[k + 1] - self.begin[k])
        if k not in self.masks:
            if len(self.masks) > 4096:
                self.masks.clear()
            mine = self.masks[k] = {}
            for i, w in enumerate(self.words[self.begin[k] : self.begin[k + 1]].tolist()):
                mine[w] = mine.get(w, 0) | (1 << i)
        lcs = longest_common(self.masks[k], size, near.tolist()) / size
        return lcs if lcs >= self.least(size) else 0.0


def latent(first: np.ndarray, t: np.ndarray, w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of sparse rows."""
    x = np.add.reduceat(basis[t] * w[:, None], first, axis=0)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _against(coded: DataFrame, index: Index, weight: np.ndarray, basis: np.ndarray, of_doc: str, kind) -> DataFrame:
    """Each row's best item of the index."""
    from pyspark.sql.pandas.types import to_arrow_type

    width, many, item_type = len(weight), len(index.ids), to_arrow_type(kind)
    steps = -(-index.reach // WINDOW)  # passages on either side that the neighbourhood of an item touches

    def candidates(p: np.ndarray, t: np.ndarray, prow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (passage, item) named by a term of the passage or of a neighbour."""
        p, k = index.named(p, t)
        pairs = own = np.unique(p * many + k)
        p, k = own // many, own % many
        for d in range(1, int(steps[k].max(initial=0)) + 1):
            far = steps[k] >= d
            for q in (p[far] - d, p[far] + d):
                ok = (q >= 0) & (q < len(prow))
                ok[ok] = prow[q[ok]] == prow[p[far][ok]]
                pairs = np.concatenate([pairs, q[ok] * many + k[far][ok]])
        pairs = np.unique(pairs)
        return pairs // many, pairs % many

    def cosines(pp: np.ndarray, k: np.ndarray, p: np.ndarray, first: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of the pairs; passages without a weighted term have 0."""
        out = np.zeros(len(pp), dtype=np.float32)
        if not len(p):
            return out
        at = np.minimum(np.searchsorted(p, pp), len(p) - 1)
        some = np.flatnonzero(p[at] == pp)
        last = np.append(first[1:], len(t))
        for a in range(0, len(some), 4096):
            mine = some[a : a + 4096]
            need, back = np.unique(at[mine], return_inverse=True)
            n = last[need] - first[need]
            begin = np.cumsum(n) - n
            pick = np.arange(n.sum()) - np.repeat(begin - first[need], n)
            out[mine] = np.einsum("ij,ij->i", latent(begin, t[pick], w[pick], basis)[back], index.target[k[mine]])
        return out

    def search(batches):
        for batch in batches:
            best: list[tuple | None] = [None] * batch.num_rows
            for i0, ids, off in sequences(batch):
                for shift in (0, WINDOW // 2):
                    p0, t0, tf, prow, at = passages(ids, off, shift, width)
                    pp, k = candidates(p0, t0, prow)
                    cos = cosines(pp, k, *vectors(p0, t0, tf, weight))
                    near = cos >= LEAST_COSINE
                    pp, k, cos = pp[near], k[near], cos[near]
                    # no more key weight can be there than in the passages around: a bound that only ends what verify() would
                    begin = np.searchsorted(p0, np.arange(len(prow) + 1))
                    most = index.weight_there(pp, k, begin, t0)
                    for d in range(1, int(steps[k].max(initial=0)) + 1):
                        for q in (pp - d, pp + d):
                            ok = np.flatnonzero((q >= 0) & (q < len(prow)) & (d <= steps[k]) & (most < index.enough[k]))
                            ok = ok[prow[q[ok]] == prow[pp[ok]]]
                            most[ok] += index.weight_there(q[ok], k[ok], begin, t0)
                    for j in np.flatnonzero(most >= index.enough[k] * (1 - 1e-5)):
                        row, start, kk, c = int(prow[pp[j]]), int(at[pp[j]]), int(k[j]), float(cos[j])
                        old = best[i0 + row]
                        if old is not None and (old[0], -old[2]) >= (c, -kk):
                            continue
                        around = [ids[off[row] + max(0, start - d) : min(off[row + 1], off[row] + start + WINDOW + d)] for d in (index.own[kk], index.reach[kk])]
                        got = index.verify(kk, *(x[x > 0] - 1 for x in around))
                        if got:
                            best[i0 + row] = (c, got, kk)
            hit = [x is not None for x in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(hit, pa.bool_()), pa.array([index.ids[x[2]] if x else None for x in best], item_type), pa.array([x[0] if x else 0.0 for x in best], pa.float64()), pa.array([x[1] if x else 0.0 for x in best], pa.float64())],
                names=["doc_id", "text_hash", "contaminated", "item_id", "cosine", "lcs"],
            )

    return coded.mapInArrow(search, f"doc_id {of_doc}, text_hash long, contaminated boolean, item_id {kind.simpleString()}, cosine double, lcs double")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))).drop("text_hash")
