"""Site-relative line frequency: lines that many pages of one host share are dropped from them.

A page's lines are its \\n-split parts, trimmed of space and \\x09-\\x0D; blank lines are neither counted nor dropped. Pages of a
host with equal text count once, above and below the line, so mass copies of a page do not turn its prose into boilerplate.
A line goes when it stands on MIN_PAGES distinct pages of the host at least and on more than 1/ONE_IN of them, whatever part of
the page such lines are: a page of nothing else is left empty. No row is ever dropped.

A null text stays null with 0 lines; an empty one stays empty; a null host is a host of its own; repeated rows get equal
results; an empty table gives no rows. Only DataFrame functions; only 8-byte hashes of lines are exchanged, summed up first.
The lines of one host to drop number at most ONE_IN times its mean lines per page, whatever its size; the table of them is
joined by host, and Spark broadcasts it only while its measured size is below spark.sql.autoBroadcastJoinThreshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ONE_IN, MIN_PAGES = 50, 3
_BLANKS = "\t\n\x0b\x0c\r "


def _parts(text):
    return F.split(text, "\n", -1)


def _hash(line):
    return F.xxhash64(F.btrim(line, F.lit(_BLANKS)))


def _has_word(line):
    return F.length(F.btrim(line, F.lit(_BLANKS))) > 0


def boilerplate(docs: DataFrame, host: str, text: str, one_in: int = ONE_IN, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, marks): the hashes of the lines to drop on each host."""
    page = F.transform(F.filter(_parts(F.col(text)), _has_word), _hash)
    pages = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(page).alias("marks"))
    pages = store.stash(pages.groupBy("host", "page").agg(F.min("marks").alias("marks")), "pages")
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    seen = pages.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    many = seen.alias("s").join(total.alias("t"), F.expr("s.host <=> t.host")).where(F.col("n") * one_in > F.col("total")).select("s.host", "mark")
    return store.stash(many.groupBy("host").agg(F.array_sort(F.collect_set("mark")).alias("marks")), "boilerplate")


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", one_in: int = ONE_IN, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the lines gone from `text`, and n_lines, n_dropped added (more underscores where docs has such columns)."""
    marks = boilerplate(docs, host, text, one_in, min_pages)
    key, hit = store.free_name("_host", docs.columns), store.free_name("_marks", docs.columns)
    marks = marks.select(F.col("host").alias(key), F.col("marks").alias(hit))
    out = docs.join(marks, docs[host].eqNullSafe(F.col(key)), "left")
    n_lines, n_dropped = (store.free_name(x, docs.columns) for x in ("n_lines", "n_dropped"))
    parts = _parts(F.col(text))
    # by hashing, in one pass over the page's lines and the host's marks: those of the marks that stand on this page
    mine = F.array_intersect(F.transform(F.filter(parts, _has_word), _hash), F.col(hit))
    out = out.withColumn(hit, F.when(F.col(hit).isNull() | F.col(text).isNull(), F.expr("cast(array() as array<long>)")).otherwise(mine))
    some = F.size(hit) > 0
    drop = lambda x: _has_word(x) & F.array_contains(F.col(hit), _hash(x))
    out = out.withColumn(n_lines, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.filter(parts, _has_word))).cast("long"))
    out = out.withColumn(n_dropped, F.when(some, F.size(F.filter(parts, drop))).otherwise(0).cast("long"))
    # a row with none of the lines keeps its text untouched
    out = out.withColumn(text, F.when(some, F.array_join(F.filter(parts, lambda x: ~drop(x)), "\n")).otherwise(F.col(text)))
    return out.drop(key, hit)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no host column; its source is the site."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


OP3_SQL = f"""
with p as (select doc_id, source, text, string_split(text, chr(10)) parts from documents),
l as (select source, text, unnest(list_distinct(list_filter(list_transform(parts, lambda x: trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')), lambda x: x <> ''))) line
      from (select distinct source, text, parts from p where text is not null)),
t as (select source, count(distinct text) total from p group by source),
m as (select l.source, line from l join t on l.source is not distinct from t.source group by l.source, line, total having count(*) >= {MIN_PAGES} and count(*) * {ONE_IN} > total),
h as (select source, list(line) marks from m group by source),
d as (select p.*, coalesce(h.marks, []::varchar[]) marks from p left join h on p.source is not distinct from h.source),
g as (select *, list_filter(parts, lambda x: trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') <> '' and list_contains(marks, trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '))) gone,
      list_filter(parts, lambda x: trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') <> '') full_ from d),
k as (select *, case when text is null then 0 else len(gone) end nd from g)
select doc_id, source,
  case when nd > 0 then array_to_string(list_filter(parts, lambda x: not (trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') <> '' and list_contains(marks, trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')))), chr(10)) else text end as text,
  case when text is null then 0 else len(full_) end::bigint as n_lines, nd::bigint as n_dropped
from k
"""
