"""Near duplicates by HyperMinHash sketches, banding, collision-corrected estimates and exact checks.

A text's set holds its distinct 5-word shingles (A-Z lower-cased); a shorter text is one shingle, a text without words or a
null has the empty set and links to nothing. Texts with equal sets form one class, worked on once. Each class has a sketch of
REGISTERS 16-bit registers (6 bits of leading zeros, 10 bits of mantissa of the least hash in the bucket; empty buckets borrow
from others by fixed permutations), cut into BANDS bands. Classes that share a band are candidates.

Within a bucket candidates are not paired with each other: all are held against one pivot and links are joined to components. For
classes of buckets that still hold different components it is then counted, over all of them, how many items of each set occur in
no other; a set with more than a quarter of such items can't link to any, nor can a pair whose shared items can't suffice. What is
left is held against the member with the fewest items of its own, PIVOT_ROUNDS times; classes that are still in different components
of a bucket are at last compared in blocks, where only links come out. So a group of n near copies costs about n rows a bucket, and no
link that could join two components goes unchecked. Estimates below a five-sigma margin end a pair; all others are confirmed on the full sets.

Ties and repeated rows: rows with equal text share a class and get equal results. A null doc_id takes part; component_id is the
least non-null doc_id of the component (null if it has none). kept is doc_id <=> component_id. An empty table gives no rows. Other
columns of docs are left alone and not returned. Long texts are read whole, in slices of rows.
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

SHINGLE, PERCENT = 5, 75
REGISTERS, MANTISSA, BANDS, ROWS = 128, 10, 32, 4
#: An estimate's standard error at 0.75 is 0.038; sets of fewer than SMALL shingles are always confirmed exactly.
LEAST_ESTIMATE, SMALL = 0.56, 256
PIVOT_ROUNDS = 2
COMPARE = 512  # classes in a block of the last comparison
_SHIFT = np.uint64(57)
_BORROW = np.argsort(tk._spread(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def shingle_sets(data: np.ndarray, off: np.ndarray):
    """The sorted distinct shingle hashes of each text."""
    n = len(off) - 1
    start, end, row = tk.words(data, off)
    hashes = tk.segment_hash(data, start, end, lower=True)
    first, value = tk.windows(hashes, row, SHINGLE)
    count = np.bincount(row, minlength=n)
    begin = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.searchsorted(first, begin)
    for i in range(n):
        if count[i] >= SHINGLE:
            yield np.unique(value[at[i] : at[i + 1]])
        elif count[i]:
            whole = count[i : i + 1].astype(np.uint64)
            for k in range(begin[i], begin[i + 1]):
                whole = tk._spread(whole * np.uint64(31) + hashes[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


_EDGES = np.arange(REGISTERS + 1, dtype=np.uint64)
_EDGES = np.concatenate([_EDGES[:-1] << _SHIFT, np.array([2**64 - 1], np.uint64)])


def sketch(unique: np.ndarray) -> np.ndarray:
    """The registers of a non-empty sorted set: the bucket is the top 7 bits, so each bucket is a run of the sorted hashes."""
    at = np.searchsorted(unique, _EDGES)
    at[-1] = len(unique)
    full = at[1:] > at[:-1]
    rest = (unique[np.minimum(at[:-1], len(unique) - 1)] & ((np.uint64(1) << _SHIFT) - np.uint64(1))) | np.uint64(1)
    top = np.frexp(rest.astype(np.float64))[1]  # bits of the rest; rounding up to the next power of two is harmless and consistent
    zeros = 57 - np.minimum(top, 57)
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    registers = (np.minimum(zeros, 63) << MANTISSA) | ((rest >> shift) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    if not full.all():
        holes = np.flatnonzero(~full)
        order = _BORROW[holes]
        registers[holes] = registers[order[np.arange(len(holes)), full[order].argmax(axis=1)]]
    return registers.astype(np.uint16)


def set_key(unique: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = tk._spread(unique)
    return b"".join(int(x).to_bytes(8, "big") for x in (a.sum(dtype=np.uint64) + np.uint64(len(unique)), np.bitwise_xor.reduce(tk._spread(a * np.uint64(3)))))


def _sketches(batches):
    for batch in batches:
        for i, j, data, off in tk.text_slices(batch):
            size, keys, regs = [], [], []
            for s in shingle_sets(data, off):
                size.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            ids = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "cls", "regs"])


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _keys(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16))
        take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("cls").take(take)], names=["band", "cls"])


def _estimated(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        ratio = np.maximum(na, nb) / np.minimum(na, nb)
        chance = 0.169919487159739 * 2.0 ** (7 - MANTISSA + 1) * 4 * ratio / (1 + ratio) ** 2  # expected equal registers of unrelated sets
        estimate = ((x == y).sum(axis=1) - chance) / (REGISTERS - chance)
        keep = (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & ((np.minimum(na, nb) < SMALL) | (estimate >= LEAST_ESTIMATE))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches):
    for batch in batches:
        for _, _, data, off in tk.text_slices(batch):
            keys, sets = [], []
            for s in shingle_sets(data, off):
                if len(s):
                    keys.append(set_key(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "items"])


def _confirmed(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the undirected edges (a, b); comp is one node of the component.

    Each round every node takes its least neighbour, parents are followed three times, and edges are rewritten between what is
    left; no node's neighbours are gathered, degrees only pass through a minimum, which is summed up before the exchange.
    """
    steps: list[DataFrame] = []
    spent = [edges := store.stash(edges.select("a", "b"), "edges")]
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        parent = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        spent.append(parent := store.stash(parent, "parents"))
        for _ in range(3):
            nxt = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            parent = parent.join(nxt, "up", "left").select("node", F.coalesce("up2", "up").alias("up"))
        spent.append(parent := store.stash(parent, "parents"))
        steps.append(parent)
        pa_, pb = (parent.select(F.col("node").alias(x), F.col("up").alias(f"u{x}")) for x in ("a", "b"))
        edges = edges.join(pa_, "a").join(pb, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        spent.append(edges := store.stash(edges, "edges"))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up", "left").select("node", F.coalesce("up2", "up").alias("up"))
    out = store.stash(out.select("node", F.col("up").alias("comp")), "components")
    store.discard(*spent)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = store.stash(docs.mapInArrow(_sketches, f"doc_id {kind}, text_hash long, n_shingles long, cls binary, regs binary"), "sketches")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = store.stash(classes, "classes")
    bands = classes.mapInArrow(_bands, "band long, cls binary")
    # what is known of a bucket is summed up first and stored, then joined: a plain join, whose large buckets Spark can split
    shared = store.stash(bands.groupBy("band").agg(F.count("*").alias("c"), F.min("cls").alias("pivot")).where("c > 1").select("band", "pivot"), "shared")
    members = store.stash(bands.join(shared, "band"), "members")  # only buckets of two or more
    store.discard(shared)
    spent = [members]  # tables that nothing reads once the components stand

    pairs = store.stash(_ordered(members.where("cls <> pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))), "pairs")
    tested, edges = pairs, confirm(classes, pairs, texts=docs)
    comp = components(edges)
    left = central = sets = None
    spent += [pairs, edges]
    for turn in range(PIVOT_ROUNDS + 1):
        here = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("band", "cls", F.coalesce("comp", "cls").alias("comp"))
        if left is None:
            apart = here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2")
            spent.append(apart := store.stash(apart.select("band"), "apart"))
            spent.append(left := store.stash(members.join(apart, "band", "left_semi").select("cls").distinct(), "left"))
            if left.isEmpty():
                break
            spent.append(sets := sets_of(docs, classes, left))
            spent.append(central := store.stash(shared_items(sets, classes), "central"))
        spent.append(here := store.stash(here.join(central, "cls"), "here"))
        if turn < PIVOT_ROUNDS:
            own = F.min(F.struct((F.col("n") - F.col("common")).alias("own"), "cls", "comp", "n", "common")).alias("p")
            spent.append(apart := store.stash(here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), own).where("lo <> hi").select("band", "p"), "apart"))
            pairs = here.join(apart, "band").where(f"comp <> p.comp and {_can('p', None)}").select(F.col("p.cls").alias("a"), F.col("cls").alias("b"))
            spent.append(pairs := store.stash(_ordered(pairs).join(tested, ["a", "b"], "left_anti"), "pairs"))
            if pairs.isEmpty():
                continue
            tested, found = tested.union(pairs), confirm(classes, pairs, sets=sets)
        else:
            found = store.stash(compare_blocks(here, classes, sets), "links")
        spent.append(found)
        if not found.isEmpty():
            edges = edges.union(found)
            spent.append(comp)
            comp = components(edges)
    store.discard(*spent)
    named = classes.select("cls", "rep").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("cls", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "cls").join(named, "cls", "left")
    whole = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", whole.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _can(x: str, y: str | None) -> str:
    """Whether two sets, of which at most `common` items are elsewhere too, can have the similarity asked for."""
    y = f"{y}." if y else ""
    return f"{100 + PERCENT} * least({x}.common, {y}common) >= {PERCENT} * ({x}.n + {y}n)"


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, items) for the classes in ids, made again from one text of each."""
    reps = ids.join(classes.select("cls", "rep"), "cls").select("rep").distinct()
    texts = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return store.stash(texts.mapInArrow(_sets, "cls binary, items binary").groupBy("cls").agg(F.first("items").alias("items")), "sets")


def _items(batches):
    for batch in batches:
        size = pc.binary_length(batch.column("items")).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in tk.slices(np.concatenate([[0], np.cumsum(size)])):  # a row an item: slices bound what a batch grows to
            part = batch.slice(i, j - i)
            cut = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("items")]
            take = pa.array(np.repeat(np.arange(len(cut)), [len(x) for x in cut]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *cut])), part.column("cls").take(take)], names=["item", "cls"])


def shared_items(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, common): the size of each set and how many of its items another of these sets has too.

    Items that no other set has can't be in an intersection; a class with too many of them links to none of the others.
    """
    own = sets.mapInArrow(_items, "item long, cls binary").groupBy("item").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1").groupBy("cls").agg(F.count("*").alias("own"))
    sizes = classes.select("cls", "n").join(sets.select("cls"), "cls")
    return sizes.join(own, "cls", "left").select("cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common")).where(f"100 * common >= {PERCENT} * n")


def _keys(regs: np.ndarray) -> np.ndarray:
    """The band keys of sketches, a row each."""
    regs = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = regs[:, :, 0]
    for k in range(1, ROWS):
        key = (key << np.uint64(16)) | regs[:, :, k]
    return tk._spread(tk._spread(key) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _linked(key, table):
    """Links between the classes of two blocks of one band, of different components; a pair counts in the first band that it shares."""
    band, i, j = (x.as_py() for x in key)
    block = table.column("block").to_numpy()
    n, common = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "common"))
    names, comps = table.column("cls").to_pylist(), table.column("comp").to_pylist()
    number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([number[c] for c in comps])
    keys = _keys(np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
    left, right, out = np.flatnonzero(block == i), np.flatnonzero(block == j), []
    for x in left:
        y = right[comp[right] != comp[x]] if i != j else right[(right > x) & (comp[right] != comp[x])]
        y = y[(100 + PERCENT) * np.minimum(common[y], common[x]) >= PERCENT * (n[y] + n[x])]
        if not len(y):
            continue
        same = keys[y] == keys[x]
        y = y[keys[x][same.argmax(axis=1)] == band]
        for z in y:
            at = np.searchsorted(sets[z], sets[x])
            both = int((sets[z][np.minimum(at, len(sets[z]) - 1)] == sets[x]).sum())
            if 100 * both >= PERCENT * (len(sets[x]) + len(sets[z]) - both):
                out.append((names[x], names[z]))
    return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})


def compare_blocks(here: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links (a, b) between different components of one band; only links come out.

    The classes of a band's largest component and all others are dealt to blocks of about COMPARE each; a task compares two blocks, of
    which one at least is of the others, so the work follows the classes that are still apart, not the square of the band.
    """
    parts = here.groupBy("band", "comp").agg(F.count("*").alias("m"))
    parts = parts.groupBy("band").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("c"))
    dealt = lambda x: F.expr(f"(({x}) + {COMPARE - 1}) div {COMPARE}")
    parts = store.stash(parts.where("c > m").select("band", "main", dealt("m").alias("bm"), dealt("c - m").alias("bo")), "parts")
    here = here.join(parts, "band")
    big, mark = F.col("comp") == F.col("main"), F.xxhash64("cls")
    here = here.withColumn("block", F.when(big, F.pmod(mark, F.col("bm"))).otherwise(F.col("bm") + F.pmod(mark, F.col("bo"))))
    here = here.withColumn("from_", F.when(big, F.col("bm")).otherwise(F.lit(0)))
    rows = here.select("band", "cls", "comp", "n", "common", "block", "from_", "bm", "bo").join(classes.select("cls", "regs"), "cls").join(sets, "cls")
    rows = rows.withColumn("other", F.explode(F.sequence(F.col("from_").cast("long"), F.col("bm") + F.col("bo") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("from_", "bm", "bo", "other")
    return rows.groupBy("band", "i", "j").applyInArrow(_linked, "a binary, b binary")


def confirm(classes: DataFrame, pairs: DataFrame, texts: DataFrame | None = None, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have a Jaccard similarity of PERCENT or more; sets are made from texts if not given."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely = store.stash(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated, "a binary, b binary"), "likely")
    mine = sets if sets is not None else sets_of(texts, classes, likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).distinct())
    side = lambda x: mine.select(F.col("cls").alias(x), F.col("items").alias(f"s{x}"))
    out = store.stash(likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed, "a binary, b binary"), "links")
    store.discard(likely, *([mine] if sets is None else []))
    return out


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) end) item from w),
n as materialized (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) n_both from s a join s b on a.item = b.item and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * n_both >= {PERCENT} * (a.n + b.n - n_both)),
e as materialized (select x, y from l union all select y, x from l),
r(doc_id, root) as (select doc_id, doc_id from n union select r.doc_id, e.y from r join e on r.root = e.x),
c as (select doc_id, min(root) component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.component_id, w.doc_id) component_id, coalesce(c.component_id, w.doc_id) = w.doc_id kept from w left join n on n.doc_id = w.doc_id left join c on c.doc_id = w.doc_id
"""
