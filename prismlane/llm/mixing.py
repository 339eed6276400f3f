"""Mixing sources to target weights, in fixed-length blocks of words, with DataFrame functions only.

Size of a text: its number of [^\\x20\\x09-\\x0D]+ (null: 0). Sources in code point order, null last, weigh WEIGHTS in turn and share
SHARE of all words; a target stops at twice its source's size and the excess is reshared by weight (solved in closed form: the
water level is the largest of the levels at which the sources filled first are full).

1. Pack: a source's texts, in the order of an MD5 of doc_id and text, form one stream cut into blocks of `block` words. Offsets are
   sums over ranges of that order and within a range; ranges are as fine as the measured number of rows asks for.
2. Shards: the mix is a row of slots, `shard_slots` a shard; each slot draws its source by the sources' shares of all draws, so a
   shard's source counts are one multinomial draw (shard_counts). A source's slots are numbered through the shards by sums of those
   counts. Numbers beyond a source's draws, of the order of the root of their count and in its last shards, go to sources that
   were drawn too seldom, so that targets are met to the word and nothing is taken more than twice.
3. Draws: source s gives round(target) words: whole passes over its blocks, then a part pass whose last block may be cut short.
   Number d of pass e is block perm[s, e](d); perm is a swap-or-not shuffle of 0..n-1 for any n (62-bit round keys), computed per
   draw, nothing stored.
4. Join: blocks and draws meet by (source, block), an even key; a block is drawn at most twice, so no document is used more
   than twice. The seed is a parameter, so reruns agree. `mixed` then meets the texts by the MD5, once, and cuts them with the white
   space as it stands: a document's pieces of one pass, one after the other, are its text.

Texts without words take nothing. Rows with equal doc_id and null ids are documents of their own; rows that repeat id and text are
summed up to one row with a count before any exchange and share the outcome in an order of no consequence. Ties in the MD5 go by id.
An empty table gives no rows. The source table (one row a source) is the only thing handled in one task; it and the table of shares
(a row a source and SHARES more) are joined on their measured size. Long texts are read whole. Only doc_id, source and text are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import store

WEIGHTS, SHARE_NUM, SHARE_DEN, MOST = (5, 2, 1), 3, 2, 2
BLOCK, SHARD_SLOTS, ROUNDS, SEED = 128, 4096, 16, 20260
SLOTS_A_TASK, ROWS_A_RANGE, COPIES, SHARES = 1 << 16, 1 << 11, 1024, 1024
_M = (1 << 31) - 1
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it; the first one also with what stands before it.
PIECE = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark (MD5 of doc_id and text), copies: rows of docs, those that repeat each other in one."""
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), mark.alias("mark"))
    return store.stash(rows.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies")), "sized")


def sources(sized: DataFrame, weights=WEIGHTS, num: int = SHARE_NUM, den: int = SHARE_DEN, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row a source: sid, source, size, weight, target, rows, n (blocks), full (whole passes), rest (words of the part pass)."""
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", most * F.col("size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(by_level), F.lit(0))
    total = F.sum("size").over(every)
    s = s.withColumn("level", ((num * total) / F.lit(float(den)) - before("cap")) / (F.sum("weight").over(every) - before("weight")).cast("double"))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
    s = s.withColumn("n", F.expr(f"(size + {block - 1}) div {block}"))
    s = s.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("full", F.expr("coalesce(words div nullif(size, 0), 0L)"))
    return s.withColumn("rest", F.col("words") - F.col("full") * F.col("size")).drop("cap", "level", "words")


# The arithmetic of the shuffle, as SQL text for Spark and for DuckDB (which writes xor and shifts otherwise). Values stay below 2^62.


def _mixed_bits(v: str, duck: bool = False) -> str:
    """31 bits of a number below 2^31, each moved by all of its bits."""
    x = (lambda a, k: f"xor({a}, ({a}) >> {k})") if duck else (lambda a, k: f"(({a}) ^ shiftright({a}, {k}))")
    one = f"(({x(v, 15)} * 739982445) & {_M})"
    return f"(({x(one, 12)} * 695872825) & {_M})"


def _round_key(stream: str, r: str, half: int, duck: bool = False) -> str:
    """Half a round key, 31 bits."""
    return _mixed_bits(f"((({stream}) * {ROUNDS} + {r}) * {(40503, 30011)[half]} + {SEED + 7919 * half}) & {_M}", duck)


def _swaps(y: str, key: str, duck: bool = False) -> str:
    """Whether round `key` swaps the pair of which y is the greater."""
    low = f"xor(({y}) & {_M}, {key})" if duck else f"((({y}) & {_M}) ^ {key})"
    high = f"(({y}) >> 31)" if duck else f"shiftright({y}, 31)"
    return f"(({_mixed_bits(f'(({low} + {high} * 69621) & {_M})', duck)} & 65536) > 0)"


def with_keys(df: DataFrame, streams: int = MOST + 1) -> DataFrame:
    """df (sid, n) with `shifts` and `keys`: the round keys of each of a source's permutations, below n and of 31 bits, one after the other."""
    a, b = (_round_key(f"(cast(sid + 1 as bigint) * {streams} + j div {ROUNDS})", f"j % {ROUNDS}", h) for h in (0, 1))
    each = f"transform(sequence(0L, {streams * ROUNDS - 1}L), j -> {{}})"  # rows are sources here
    return df.withColumn("shifts", F.expr(each.format(f"({a} * {1 << 31} + {b}) % greatest(n, 1L)"))).withColumn("keys", F.expr(each.format(b)))


def shuffled(df: DataFrame, x: str, e: str, out: str, inverse: bool = False) -> DataFrame:
    """df (n, shifts, keys) with `out`: the place of x in permutation e of 0..n-1 (swap-or-not), round after round as plain columns."""
    keep = [c for c in df.columns if c != out]
    df = df.select(*keep, F.col(x).cast("long").alias(out), *[F.expr(f"slice({k}, cast({e} * {ROUNDS} + 1 as int), {ROUNDS})").alias(o) for k, o in (("shifts", "k0_"), ("keys", "k1_"))])
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        df = df.withColumn("o_", F.expr(f"if(k0_[{r}] >= {out}, k0_[{r}] - {out}, k0_[{r}] - {out} + n)"))
        df = df.withColumn("y_", F.greatest(out, "o_"))
        df = df.withColumn(out, F.expr(f"if({_swaps('y_', f'k1_[{r}]')}, o_, {out})"))
    return df.drop("o_", "y_", "k0_", "k1_")


def planned(src: DataFrame, block: int = BLOCK) -> DataFrame:
    """src with keys, tail (size of the last block), short_at (where the part pass meets that), d (draws), from_ (draws before) and all_."""
    s = with_keys(src.where("n > 0").withColumn("tail", F.col("size") - (F.col("n") - 1) * block).withColumn("last_", F.col("n") - 1))
    s = shuffled(s, "last_", "full", "short_at", inverse=True)
    s = s.withColumn("m0", F.expr(f"(rest + {block - 1}) div {block}"))
    lost = F.when(F.col("short_at") < F.col("m0"), block - F.col("tail")).otherwise(0)
    part = F.when(F.col("m0") * block - lost < F.col("rest"), F.col("m0") + 1).otherwise(F.col("m0"))
    s = s.withColumn("d", F.col("full") * F.col("n") + F.least(part, F.col("n")))
    s = s.withColumn("from_", F.coalesce(F.sum("d").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("all_", F.sum("d").over(W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where("d > 0")
    return store.stash(s.select("sid", "n", "full", "rest", "tail", "short_at", "d", "from_", "all_", "shifts", "keys"), "plan")


def slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, sid): each slot with the source that it draws, by the sources' shares of all draws."""
    spark, total = plan.sparkSession, plan.agg(F.max("all_")).first()[0] or 0
    shards = -(-total // shard_slots)
    cut = lambda c: F.floor(c / F.col("all_") * (1 << 31)).cast("long")
    wide = (1 << 31) // SHARES
    table = plan.select("sid", cut(F.col("from_")).alias("lo"), cut(F.col("from_") + F.col("d")).alias("hi")).where("lo < hi")
    table = store.stash(table.withColumn("range", F.explode(F.expr(f"sequence(lo div {wide}, (hi - 1) div {wide})"))), "shares")
    s = spark.range(0, shards, 1, max(1, -(-total // SLOTS_A_TASK))).withColumnRenamed("id", "shard")
    s = s.withColumn("slot", F.explode(F.expr(f"sequence(shard * {shard_slots}, least((shard + 1) * {shard_slots}, {total}L) - 1)")))
    s = s.withColumn("tick", F.expr(f"{_round_key('slot', '0', 0)} ^ {_round_key('slot', '0', 1)}")).withColumn("range", F.expr(f"tick div {wide}"))
    # left joins here and below: the planner takes rows that have yet to multiply for few, and would send them out as the small side
    fits = (s["range"] == table["range"]) & (F.col("lo") <= F.col("tick")) & (F.col("tick") < F.col("hi"))
    return s.join(table, fits, "left").select("shard", "slot", "sid")


def shard_counts(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source, n): the multinomial draw of each shard, before the balance of totals."""
    src = store.stash(sources(measured(docs), block=block), "sources")
    return slots(planned(src, block), shard_slots).groupBy("shard", "sid").agg(F.count("*").alias("n")).join(src.select("sid", "source"), "sid", "left").select("shard", "source", "n")


def numbered(plan: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, sid, i): i numbers a source's slots through all shards; each number below the source's draws stands once."""
    drawn = slots(plan, shard_slots)
    counts = store.stash(drawn.groupBy("shard", "sid").agg(F.count("*").alias("m")).withColumn("part", F.expr(f"shard div {SHARES}")), "counts")
    before = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    far = counts.groupBy("sid", "part").agg(F.sum("m").alias("m")).withColumn("far", F.coalesce(F.sum("m").over(before("sid").orderBy("part")), F.lit(0))).drop("m")
    near = counts.withColumn("near", F.coalesce(F.sum("m").over(before("sid", "part").orderBy("shard")), F.lit(0)))
    base = near.join(far, ["sid", "part"]).select("shard", "sid", (F.col("far") + F.col("near")).alias("base"))
    out = drawn.withColumn("k", F.row_number().over(W.partitionBy("shard", "sid").orderBy("slot")) - 1)
    out = out.join(base, ["shard", "sid"], "left").select("shard", "slot", "sid", (F.col("base") + F.col("k")).alias("i"))
    # what a source drew beyond its draws goes, number by number, to those that drew too few
    got = plan.select("sid", "d").join(counts.groupBy("sid").agg(F.sum("m").alias("m")), "sid", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    sums = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))).over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = store.stash(got.withColumn("over", sums(F.col("m") - F.col("d"))).withColumn("under", sums(F.col("d") - F.col("m"))), "balance")
    out = store.stash(out.join(got.select("sid", "d", "over"), "sid", "left"), "numbers")
    extra = out.where("i >= d").select("shard", "slot", (F.col("over") + F.col("i") - F.col("d")).alias("g"))
    few = got.where("m < d").withColumn("j", F.explode(F.expr("sequence(0L, d - m - 1)"))).select("sid", (F.col("m") + F.col("j")).alias("i"), (F.col("under") + F.col("j")).alias("g"))
    cols = ["shard", "slot", "sid", "i"]
    return out.where("i < d").select(cols).unionByName(extra.join(few.hint("merge"), "g").select(cols))


def draws(src: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(sid, block, words, slot, shard) for each draw of a block."""
    plan = planned(src, block)
    s = numbered(plan, shard_slots).join(plan.drop("from_", "all_", "d"), "sid", "left").withColumn("e", F.expr("i div n")).withColumn("k", F.expr("i % n"))
    s = shuffled(s, "k", "e", "block")
    size = F.when(F.col("block") == F.col("n") - 1, F.col("tail")).otherwise(block)
    before = F.col("k") * block - F.when(F.col("short_at") < F.col("k"), block - F.col("tail")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(size, F.col("rest") - before))
    s = s.withColumn("words", F.when(F.col("e") < F.col("full"), size).otherwise(part).cast("long"))
    # stored, as a filter or join above would be pushed below the rounds and written out once for each way through them
    return store.stash(s.select("sid", "block", "words", "slot", "shard"), "draws").where("words > 0")


def packed(sized: DataFrame, src: DataFrame) -> DataFrame:
    """sized, of texts with words, with sid and the offset `at` of each row in its source's stream."""
    names = src.select("sid", F.col("source").alias("source_"))
    digits, most = 0, src.agg(F.max("rows")).first()[0] or 0
    while most > ROWS_A_RANGE * 16**digits:
        digits += 1
    d = sized.where("size > 0").withColumn("range", F.substring("mark", 1, digits)).withColumn("words", F.col("size") * F.col("copies"))
    d = d.join(names, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    prior = W.partitionBy("sid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("sid", "range").agg(F.sum("words").alias("s"))
    sums = sums.select("sid", "range", F.coalesce(F.sum("s").over(prior), F.lit(0)).alias("base"))
    within = W.partitionBy("sid", "range").orderBy("mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("words").over(within), F.lit(0))).join(sums, ["sid", "range"], "left")
    return d.withColumn("at", F.col("at") + F.col("base")).drop("base", "range", "words")


def copied(rows: DataFrame) -> DataFrame:
    """A row for each copy, numbered `copy`; a row with many is dealt to tasks, COPIES copies a time."""
    out = rows.where(f"copies <= {COPIES}").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    many = rows.where(f"copies > {COPIES}")
    total = many.agg(F.sum("copies")).first()[0]
    if not total:
        return out
    many = many.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition(-(-total // SLOTS_A_TASK) + 1, "mark", "chunk")
    return out.unionByName(many.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {COPIES}, least(copies, (chunk + 1) * {COPIES}) - 1)"))).drop("chunk"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each block that a copy of a text reaches: block, first (its place in the block), skip (words of the text before), n."""
    at = f"(at + copy * size)"
    spans = F.expr(
        f"transform(sequence({at} div {block}, ({at} + size - 1) div {block}), b -> struct(b as block, greatest(b * {block}, {at}) - b * {block} as first, "
        f"greatest(b * {block}, {at}) - {at} as skip, least((b + 1) * {block}, {at} + size) - greatest(b * {block}, {at}) as n))"
    )
    keep = ["sid", "doc_id", "mark", "source", "size", "copy", "at"]
    return copied(placed).select(*keep, F.explode(spans).alias("p")).select(*keep, "p.*")


def usage(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    sized = measured(docs)
    src = store.stash(sources(sized, block=block), "sources")
    used = draws(src, block).select("sid", "block", "words")
    part = pieces(store.stash(packed(sized, src), "packed"), block)
    part = part.join(used.hint("merge"), ["sid", "block"], "left")  # both sides grow with the words
    took = F.greatest(F.lit(0), F.least(F.coalesce("words", F.lit(0)) - F.col("first"), F.col("n")))  # an undrawn block has no words
    taken = part.groupBy("sid", "at", "copy", "doc_id", "size").agg(F.sum(took).cast("long").alias("taken"))
    named = src.select("sid", "source", F.col("size").alias("source_size"), "target")
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    some = taken.join(named, "sid", "left").select(cols)
    none = copied(sized.where("size = 0")).alias("z").join(named.alias("m"), F.expr("z.source <=> m.source"), "left").select("z.doc_id", "z.source", "z.size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def _key(mark: str, source: str) -> Column:
    return F.concat(F.col(mark), F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))))


def mixed(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: shard, slot, first (place in the block), source, doc_id, first_word, n_words, text; order by slot, first to read it."""
    docs = docs.select("doc_id", "source", "text")
    sized = measured(docs)
    src = store.stash(sources(sized, block=block), "sources")
    part = pieces(store.stash(packed(sized, src), "packed"), block).join(draws(src, block, shard_slots).hint("merge"), ["sid", "block"]).where("first < words")
    n = F.least(F.col("n"), F.col("words") - F.col("first"))
    part = part.select(_key("mark", "source").alias("key"), "copy", "doc_id", "source", F.struct("shard", "slot", "first", "skip", n.alias("n")).alias("p"))
    # the pieces of one copy of a text meet it as one row: as many as the text has blocks
    part = part.groupBy("key", "copy", "doc_id", "source").agg(F.collect_list("p").alias("ps"))
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    texts = docs.where(n_words("text") > 0).withColumn("mark", mark).select(_key("mark", "source").alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    out = part.join(texts.hint("merge"), "key")
    piece = lambda ws, p: F.struct(*[p[c].alias(c) for c in ("shard", "slot", "first", "skip", "n")], F.array_join(F.slice(ws, (p["skip"] + 1).cast("int"), p["n"].cast("int")), "").alias("text"))
    # the words are an argument of the outer lambda, so they are made once for a text; a column would be moved into the inner one
    cut = F.transform(F.array(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))), lambda ws: F.transform("ps", lambda p: piece(ws, p)))
    out = out.select("source", "doc_id", F.explode(F.flatten(cut)).alias("p"))
    return out.select("p.shard", "p.slot", "p.first", "source", "doc_id", F.col("p.skip").alias("first_word"), F.col("p.n").alias("n_words"), "p.text")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _perm(x: str, n: str, stream: str, inverse: bool = False) -> str:
    rounds = list(range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))
    a, b = (_round_key(stream, "r", h, True) for h in (0, 1))
    other = f"(({a} * {1 << 31} + {b}) % {n} - x + case when ({a} * {1 << 31} + {b}) % {n} >= x then 0 else {n} end)"
    return f"(case when {n} > 1 then list_reduce({rounds}::bigint[], lambda x, r: case when {_swaps(f'greatest(x, {other})', b, True)} then {other} else x end, ({x})::bigint) else 0 end)"


OP1_SQL = f"""
with recursive sized as materialized (select doc_id, source, md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) mark, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end::bigint size from documents),
s0 as (select source, sum(size)::bigint size from sized group by source),
s1 as (select *, row_number() over (order by source is null, source) - 1 sid from s0),
s2 as (select *, (case sid % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint weight, {MOST} * size cap from s1),
s3 as (select *, (({SHARE_NUM} * sum(size) over ())::double / {SHARE_DEN} - coalesce(sum(cap) over w, 0)::double) / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double lvl
  from s2 window w as (order by cap::double / weight, sid rows between unbounded preceding and 1 preceding)),
s4 as (select *, least(cap::double, max(lvl) over () * weight) target, (size + {BLOCK - 1}) // {BLOCK} n from s3),
s5 as (select *, coalesce(floor(target + 0.5)::bigint // nullif(size, 0), 0) full_ from s4),
s6 as (select *, floor(target + 0.5)::bigint - full_ * size rest, size - (n - 1) * {BLOCK} tail from s5),
s7 as materialized (select *, {_perm("n - 1", "n", f"(sid + 1) * {MOST + 1} + full_", True)} short_at, (rest + {BLOCK - 1}) // {BLOCK} m0 from s6 where n > 0),
s8 as (select *, full_ * n + least(case when m0 * {BLOCK} - case when short_at < m0 then {BLOCK} - tail else 0 end < rest then m0 + 1 else m0 end, n) d from s7),
i as (select *, unnest(range(d)) i from s8),
k as (select *, i // n e, i % n k from i),
b as materialized (select *, {_perm("k", "n", f"(sid + 1) * {MOST + 1} + e")} block from k),
c as (select *, case when block = n - 1 then tail else {BLOCK} end blen, k * {BLOCK} - case when short_at < k then {BLOCK} - tail else 0 end before_ from b),
u as (select sid, block, case when e < full_ then blen else greatest(0, least(blen, rest - before_)) end words from c),
p as (select z.doc_id, z.size, m.sid, coalesce(sum(z.size) over (partition by m.sid order by z.mark, z.doc_id nulls first, z.size rows between unbounded preceding and 1 preceding), 0)::bigint pos
  from sized z join s2 m on z.source is not distinct from m.source where z.size > 0),
q as (select *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) block from p),
t as (select q.sid, q.pos, q.doc_id, q.size, sum(greatest(0, least(coalesce(u.words, 0) - (greatest(q.block * {BLOCK}, pos) - q.block * {BLOCK}), least((q.block + 1) * {BLOCK}, pos + q.size) - greatest(q.block * {BLOCK}, pos))))::bigint taken
  from q left join u on q.sid = u.sid and q.block = u.block group by all)
select t.doc_id, m.source, t.size, m.size source_size, m.target, t.taken from t join s4 m on t.sid = m.sid
union all
select z.doc_id, z.source, z.size, m.size, m.target, 0::bigint from sized z join s4 m on z.source is not distinct from m.source where z.size = 0
"""
