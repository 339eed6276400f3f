"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer turns words and marks into symbols: insult, threat, target, negation, report, adversative, other word, comma,
quote, colon, clause end, line end. Two machines, each composed of transducers, rewrite them. The first reads a line from its end and
marks insults and threats that a target follows in the clause, or a report does ("..., he said"; after a quote, back to where it
opens). The second reads from the start: what a negation governs (the next REACH words, not beyond a comma or adversative; a
parenthesis between commas right after it does not count), what a report introduces (up to the clause's end, through a colon, or to
the end of the quote that it opens), what a target precedes. Each insult or threat leaves as negated, reported, aimed at someone, or
plain, in this order. A text's evidence is the lexicon weight of its best clause for each kind of match and the number of matched
clauses; a logistic model turns it into a score. Isolated words outside the lexicon weigh nothing, and a text without a match gets
the base score.

Insult words and stems (4 to 7 letters) are learned from labelled rows whose crc32(doc_id) mod 3 is not 1: about SAMPLE texts of
each label by a hash of doc_id, whole texts, document counts summed on the executors; a word or stem enters by its log odds when
its share of toxic texts can't be chance among all candidates; all that pass enter. Threats (with their inflections), targets, negations
and reports are the fixed lists below; their weights are learned too, an aimed threat starts at AIMED_THREAT.
labels, lang, source and doc_id are no inputs of a score. A null or empty text scores as a text without a match; long texts are read whole,
line by line. Without labels of both kinds the score is the share of label 1 (0 without labels). An id with several texts
is learned from its least, one labelled 0 and 1 counts for both. Rows are judged alone; repeated rows get equal scores. An empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkit as tk
from .langid import bucket

store.by_value(tk.__name__)
store.by_value(__name__)

SAMPLE, STEMS, LEAST_SHARE, MARGIN, CUT = 20000, (4, 5, 6, 7), 0.6, 3.0, 0.7
REACH, REPORT_REACH = 5, 3  # words that a negation governs; words between a report and the comma or quote before it
AIMED_THREAT = 6.0  # the weight of an aimed threat where the labels say nothing of it


def _inflected() -> set[str]:
    """Forms of the threat verbs."""
    out = {"erschlägt", "erschlug", "umgebracht", "umbringen", "shot", "abgestochen"}
    for stem in ("kill", "murder", "slaughter", "behead", "lynch"):
        out |= {stem + e for e in ("", "s", "es", "ed", "ing")}
    for stem in ("strangl", "chok"):
        out |= {stem + e for e in ("e", "es", "ed", "ing")}
    out |= {"stab" + e for e in ("", "s", "bed", "bing")} | {"shoot" + e for e in ("", "s", "ing")}
    for stem in ("töt", "ermord", "erwürg", "erschlag", "umbring"):
        out |= {stem + e for e in ("e", "en", "et", "t", "est", "te", "ete", "ten", "eten", "end")}
    for stem in ("asesin", "estrangul", "degoll", "mat"):
        out |= {stem + e for e in ("ar", "o", "as", "amos", "an", "é", "aste", "ó", "aron", "aré", "arás", "ará", "aremos", "arán", "aría", "ando", "ado", "arte", "arlo", "arla", "aros")}
    for stem in ("assassin", "étrangl", "égorg", "massacr", "poignard"):
        out |= {stem + e for e in ("er", "e", "es", "ons", "ez", "ent", "é", "ée", "és", "ées", "erai", "eras", "era", "erons", "erez", "eront", "ait", "ant")}
    return out | {"tuer", "tue", "tues", "tuez", "tuent", "tué", "tuée", "tués", "tuerai", "tuera", "tueras", "tuerons", "tuerez", "tueront", "tuait"}


THREAT = _inflected()
TARGET = {
    "you", "your", "yourself", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "euch", "ihr", "ihn", "ihm", "ihnen", "er", "sie", "tú", "te", "ti", "usted", "ustedes", "vosotros", "él", "ella", "ellos",
    "tu", "toi", "vous", "il", "elle", "ils", "eux", "lui",
}
NEGATION = {
    "not", "no", "never", "nor", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "can't", "cannot", "nicht", "kein", "keine", "keinen", "keiner", "nie", "niemals", "nunca", "jamás", "ne", "pas", "jamais", "n'est", "n'es", "n'êtes",
}
REPORT = {
    "said", "say", "says", "saying", "told", "tells", "wrote", "called", "quoted", "claimed", "claims", "shouted", "yelled", "replied", "sagte", "sagt", "meinte", "rief", "schrieb", "nannte", "behauptet", "behauptete",
    "dijo", "dice", "decía", "escribió", "llamó", "gritó", "dit", "disait", "écrit", "appelé", "cria", "répondit",
}
ADVERSATIVE = {"but", "aber", "sondern", "pero", "sino", "mais"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;]+|[,:]|[\"“”„«»]")
_MARK = {",": "K", ":": "D"} | dict.fromkeys("\"“”„«»", "Q")


class Machine:
    """A deterministic transducer: step(state, symbol) gives (state, symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Machine") -> "Machine":
        """This machine's output is the other's input."""

        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Machine((self.start, other.start), step)

    def table(self, alphabet: str) -> dict:
        """All transitions that can be reached."""
        out, todo = {}, [self.start]
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                if (state, symbol) not in out:
                    out[state, symbol] = got = self.step(state, symbol)
                    todo.append(got[0])
        return out


# I insult, H threat, T target, N negation, R report, X adversative, O other word, K comma, Q quote, D colon, C clause end, L line end
ALPHABET = "IHTNRXOKQDCL"
# plain, aimed (A, B), reported (r, q), negated (i, h)
KINDS = "IHAirqBh"
EVIDENCE = len(KINDS) + 3
_INSULTS, _THREATS = "IAr", "HBq"
_FRESH, _ASIDE = REACH + 1, REACH + 2


def _as(s: str, insult: str, threat: str) -> str:
    return insult if s in _INSULTS else threat if s in _THREATS else s


def _negation(state, s):
    """State: words still governed; _FRESH right after a negation; _ASIDE in a parenthesis that stands right after it."""
    if s == "N":
        return _FRESH, s
    if s in "CLX":
        return 0, s
    if s == "K":
        return {_FRESH: _ASIDE, _ASIDE: REACH}.get(state, 0), s
    if s in "QD" or state in (0, _ASIDE):
        return state, s
    return (REACH if state == _FRESH else state) - 1, _as(s, "i", "h")


def _report(state, s):
    """State: 1 after a report, to the clause's end; 2 in the quote that it opened."""
    if s == "R":
        return max(1, state), s
    if s == "Q":
        return {1: 2}.get(state, 0), s
    if s in "CL":
        return (2 if state == 2 and s == "C" else 0), s
    return state, (_as(s, "r", "q") if state else s)


_QUOTED, _BEFORE = REPORT_REACH + 2, REPORT_REACH + 1


def _reported_later(state, s):
    """From the end. State: words until the comma or quote that a report needs before it; _BEFORE to the clause's start; _QUOTED to the quote's."""
    if s == "L" or (s == "C" and state != _QUOTED):
        return 0, s
    if s == "R":
        return (state if state >= _BEFORE else REPORT_REACH), s
    if s == "Q":
        return (0 if state in (0, _QUOTED) else _BEFORE if state == _BEFORE else _QUOTED), s
    if state >= _BEFORE:
        return state, _as(s, "r", "q")
    if s in "KD":
        return (_BEFORE if state and s == "K" else 0), s
    return max(0, state - 1), s


def _target(state, s):
    """State: whether a target stood in the clause; of use in both directions."""
    if s in "CL":
        return 0, s
    return (1 if s == "T" else state), ({"I": "A", "H": "B"}.get(s, s) if state else s)


def machines() -> tuple[tuple, tuple]:
    """(start, transitions) of the machine read from the end of a line, and of the one read from its start."""
    back = Machine(0, _reported_later).then(Machine(0, _target))
    fore = Machine(0, _negation).then(Machine(0, _report)).then(Machine(0, _target))
    return (back.start, back.table(ALPHABET)), (fore.start, fore.table(ALPHABET + "ABrq"))


class Lexicon:
    """Finds texts with a lexicon word in one pass, then reads their clauses."""

    def __init__(self, entries: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.stems = dict(entries), dict(stems)
        self.find = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREAT]:
            self.find.add_word(w, len(w))
        self.find.make_automaton()
        (self.last, self.back), (self.first, self.fore) = machines()
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = self._symbol(word)
        return got

    def _symbol(self, word: str) -> tuple[str, float]:
        if not word[0].isalpha():
            return _MARK.get(word, "C"), 0.0
        word = word.replace("’", "'")
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS)])
        if weight > 0:
            return "I", weight
        for s, group in (("H", THREAT), ("N", NEGATION), ("R", REPORT), ("T", TARGET), ("X", ADVERSATIVE)):
            if word in group:
                return s, 1.0
        return "O", 0.0

    def rewritten(self, symbols: list[str]) -> list[str]:
        """What both machines make of a line's symbols."""
        out, state = [], self.last
        for s in reversed(symbols):
            state, got = self.back[state, s]
            out.append(got)
        out.reverse()
        state = self.first
        for k, s in enumerate(out):
            state, out[k] = self.fore[state, s]
        return out

    def evidence(self, text: str | None) -> list[float]:
        """For each kind of match the weight of the best clause; the log of the number of matched clauses; the weight of the strongest
        word in them, and its square."""
        out, n, top = dict.fromkeys(KINDS, 0.0), 0, 0.0
        text, done = (text or "").lower(), -1
        for end, size in self.find.iter(text):
            first = end - size + 1
            if end < done or (first and text[first - 1].isalpha()):
                continue
            begin, done = text.rfind("\n", 0, first) + 1, text.find("\n", first)
            done = len(text) if done < 0 else done
            read = [self.symbol(w) for w in _TOKEN.findall(text, begin, done)]
            clause = dict.fromkeys(KINDS, 0.0)
            for got, (_, weight) in zip([*self.rewritten([s for s, _ in read]), "C"], [*read, ("C", 0.0)]):
                if got in clause:
                    clause[got] += weight
                    top = max(top, weight)
                elif got == "C" and any(clause.values()):
                    n += 1
                    for k, v in clause.items():
                        out[k] = max(out[k], v)
                    clause = dict.fromkeys(KINDS, 0.0)
        return [*(min(out[k], 10.0) for k in KINDS), math.log1p(n), top, top * top / 10]


def _counted(batches):
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text")):
            for w in set(_WORD.findall((text.as_py() or "").lower())):
                seen.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["w", "c", "t"])


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(y, text) of about `sample` labelled ids of each label, none of them held out; an id with several texts gives its least."""
    mine = labels.where("toxic in (0, 1)").where(bucket("doc_id", 3) != 1).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    share = mine.groupBy("y").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    mine = mine.join(share, "y").where(u < F.col("share")).select("doc_id", "y")
    # about 2 * sample distinct ids by construction: small enough to send to the texts; repeated ids are summed up before the exchange
    return docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")


def learn(train: DataFrame) -> tuple[dict[str, float], dict[str, float], list[int]]:
    """Words, stems, and the number of texts of each label."""
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return {}, {}, [n0, n1]
    words = train.mapInArrow(_counted, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    cut = F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEMS])
    stems = words.select(F.explode(F.array_compact(cut)).alias("w"), "c", "t").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.count("*").alias("forms"))
    base = n1 / (n0 + n1)
    p = F.col("t") / (F.col("t") + F.col("c"))
    surprise = (F.col("t") + F.col("c")) * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    out = []
    for table, extra in ((words, F.lit(True)), (stems, F.col("forms") >= 2)):
        kept = table.where(extra).where("t > 1").select("w", odds.alias("odds"), p.alias("p"), surprise.alias("surprise"))
        least = F.log(F.lit(float(n0 + n1))) + MARGIN
        kept = kept.where((F.col("surprise") > least) & (F.col("p") >= LEAST_SHARE) & (F.col("odds") > 0))
        out.append({r["w"]: r["odds"] for r in kept.collect()})  # of a bounded sample, those beyond chance
    return out[0], out[1], [n0, n1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights, drawn to `prior` (zero if not given), and, last, the intercept, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    mean = np.append(np.zeros(x.shape[1]) if prior is None else prior, 0.0)
    w, pull = mean.copy(), ridge * len(y) / 100 * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.eye(len(w)) / 100
        step = np.linalg.solve(h, a.T @ (p - y) + pull * (w - mean))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """df with `toxicity` (more underscores if df has such a column)."""
    train = store.stash(sampled(docs, labels), "toxic-sample")
    words, stems, size = learn(train)
    weights = None
    if words or stems:

        def read(batches):
            lexicon = Lexicon(words, stems)
            for batch in batches:
                found = np.array([lexicon.evidence(t.as_py()) for t in batch.column("text")]).reshape(-1, EVIDENCE)
                yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1]))], names=["y", *(f"e{k}" for k in range(found.shape[1]))])

        got = train.mapInArrow(read, "y int, " + ", ".join(f"e{k} double" for k in range(EVIDENCE)))
        # equal evidence is one row with a count: the driver gets kinds of evidence, not texts
        cols = [f"e{k}" for k in range(EVIDENCE)]
        rows = got.select("y", *[F.round(c, 2).alias(c) for c in cols]).groupBy("y", *cols).agg(F.count("*").alias("n")).toPandas()
        rep = np.repeat(np.arange(len(rows)), rows["n"].to_numpy())
        prior = np.zeros(EVIDENCE)
        prior[KINDS.index("B")] = AIMED_THREAT
        weights = logistic(rows[cols].to_numpy(dtype=float)[rep], rows["y"].to_numpy(dtype=float)[rep], prior=prior)
    base = size[1] / max(1, sum(size))
    name = store.free_name("toxicity", df.columns)

    def run(batches):
        lexicon = Lexicon(words, stems) if weights is not None else None
        for batch in batches:
            if lexicon is None:
                got = np.full(batch.num_rows, base)
            else:
                e = np.array([lexicon.evidence(t.as_py()) for t in batch.column(text)]).reshape(-1, EVIDENCE)
                got = 1 / (1 + np.exp(-np.clip(e @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{name}` double"])
    return df.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    out = score(docs, docs, labels)
    return out.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))
