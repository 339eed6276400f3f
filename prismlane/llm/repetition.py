"""Repetition coverage: characters inside duplicated n-grams and lines, by rolling hashes of several lengths.

Words are runs of bytes other than space and \\x09-\\x0D, case kept. For each n in GRAMS the words covered by an n-word window
that stood in the text before are marked, and their code points divided by those of all words; so a text said twice has a share
of one half. The base rule counts the first occurrence too. Lines are cut at \\n.
A null or empty text has no words: all counts 0, all shares 0.0 and it fails the base rule. Whole texts are read; a text is
judged on its own, so repeated rows get equal results and no data are exchanged. Other columns of the input pass through, clashing names get underscores. An
empty table gives no rows. Memory follows the longest text; there are no ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import store, textkit as tk

store.by_value(tk.__name__)
store.by_value(__name__)

#: Largest share of a text's word characters that windows found before may cover, by window length in words.
GRAMS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
MAX_DUP_LINE_CHARS = 0.30
MAX_DUP_LINES = 0.50
MIN_WORDS, BASE_PERCENT, BASE_WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars double, " + ", ".join(f"dup_{n}_gram_chars double" for n in GRAMS)
)


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All figures for the texts data[off[i]:off[i+1]]."""
    n = len(off) - 1
    start, end, row = tk.words(data, off)
    lead = (data & 0xC0) != 0x80
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(lead, out=points[1:])
    size = points[end] - points[start]
    count = np.bincount(row, minlength=n)
    chars = np.bincount(row, weights=size, minlength=n).astype(np.int64)
    out = {"n_words": count, "word_chars": chars, "n_symbols": tk.per_row(_SYMBOL[data], off)}

    a, b, lrow = tk.lines(data, off)
    has_word = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b, lrow = a[has_word], b[has_word], lrow[has_word]
    _, later = tk.repeated(tk.salted(tk.segment_hash(data, a, b), lrow))
    out["n_dup_lines"] = np.bincount(lrow[later], minlength=n)
    n_lines = np.bincount(lrow, minlength=n)
    line_chars = np.bincount(lrow, weights=points[b] - points[a], minlength=n)
    dup_chars = np.bincount(lrow[later], weights=(points[b] - points[a])[later], minlength=n)
    out["dup_line_chars"] = dup_chars / np.maximum(line_chars, 1)

    hashes = tk.segment_hash(data, start, end)
    bad = (out["dup_line_chars"] > MAX_DUP_LINE_CHARS) | (out["n_dup_lines"] > MAX_DUP_LINES * np.maximum(n_lines, 1))
    for k, most in GRAMS.items():
        first, value = tk.windows(hashes, row, k)
        twice, later = tk.repeated(tk.salted(value, row[first]))
        inside = tk.covered(first[later], k, len(row))
        share = np.bincount(row[inside], weights=size[inside], minlength=n) / np.maximum(chars, 1)
        out[f"dup_{k}_gram_chars"] = share
        bad |= share > most
        if k == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(row[tk.covered(first[twice], k, len(row))], minlength=n)
    out["base_failed"] = (count < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * count)
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of SCHEMA added (named with more underscores if df has such a column)."""
    added = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
    names = {c: store.free_name(c, df.columns) for c in added}

    def run(batches):
        for batch in batches:
            for i, j, data, off in tk.text_slices(batch, text):
                found = measure(data, off)
                cols = [pa.array(found[c].astype({"long": np.int64, "double": np.float64, "boolean": bool}[t])) for c, t in added.items()]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *cols], names=[*batch.schema.names, *names.values()])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{names[c]}` {t}" for c, t in added.items()])
    return df.mapInArrow(run, schema)


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _sql() -> str:
    word = "'[^\\x20\\x09-\\x0D]+'"
    parts, joins, cols, bad = [], [], [], []
    for k in sorted({*GRAMS, BASE_WINDOW}):
        parts.append(
            f"w{k} as (select rid, i, row_number() over (partition by rid, key order by i) nth, count(*) over (partition by rid, key) n from (select rid, i, array_to_string(ws[i:i + {k - 1}], ' ') key from x where i + {k - 1} <= n_words)), "
            f"c{k} as (select rid, sum(size) chars, count(*) n from (select distinct w.rid, x.i, x.size from w{k} w join x on x.rid = w.rid and x.i between w.i and w.i + {k - 1} where nth > 1) group by rid)"
        )
        joins.append(f"left join c{k} on c{k}.rid = b.rid")
        cols.append(f"coalesce(c{k}.chars, 0)::double / greatest(b.word_chars, 1) dup_{k}_gram_chars")
        bad.append(f"dup_{k}_gram_chars > {GRAMS[k]}::double")
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
a as (select *, regexp_extract_all(t, {word}) ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {word})) ls from d),
b as (select rid, doc_id, ws, ls, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) line_chars, coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(x))), 0) once_chars from a),
x as (select rid, n_words, ws, unnest(range(1, n_words + 1)) i, length(ws[i]) size from b where n_words > 0),
{", ".join(parts)},
r as (select rid, count(*) n from (select distinct w.rid, x.i from w{BASE_WINDOW} w join x on x.rid = w.rid and x.i between w.i and w.i + {BASE_WINDOW - 1} where w.n > 1) group by rid),
m as (select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, len(b.ls) n_lines, (b.line_chars - b.once_chars)::double / greatest(b.line_chars, 1) dup_line_chars, {", ".join(cols)}
  from b left join r on r.rid = b.rid {" ".join(joins)}),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {BASE_PERCENT} * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (dup_line_chars > {MAX_DUP_LINE_CHARS}::double or n_dup_lines > {MAX_DUP_LINES}::double * greatest(n_lines, 1) or {" or ".join(bad)}) as kept,
  dup_line_chars, {", ".join(f"dup_{k}_gram_chars" for k in GRAMS)} from f
"""


OP7_SQL = _sql()
