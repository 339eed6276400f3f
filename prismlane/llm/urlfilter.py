"""URL filter: domain and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; for a null
url or one without `://` both are empty. The longest rule that fits decides. Else the automaton runs once over the whole url (scheme,
host, path, query and fragment; percent references decoded once, A-Z lower-cased), with or without `://`; an occurrence counts only
between characters that are no ASCII letters or digits. One strict term, or soft terms (each counted once) whose weights reach the
bound, give block; else allow. No soft term reaches the bound alone. Rules, terms, weights and bound are arguments. The automaton is
built once per task from the lists; rows are judged alone, so repeated rows agree, a null url has no hits, long urls are read whole,
an empty table gives no rows, other columns pass through and clashing names get underscores.
"""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

store.by_value(__name__)

#: (rule, verdict), as host/path; a rule fits its host and all subdomains.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
STRICT = ["adult", "bets", "betting", "casino", "escort", "escorts", "gambling", "hentai", "jackpot", "poker", "porn", "porno", "roulette", "sex", "slots", "viagra", "warez", "xxx"]
#: Soft terms and their weights: 2 for words that seldom stand in a clean address, 1 for those that do.
SOFT = {
    "ads": 2, "affiliate": 2, "bonus": 1, "cheap": 1, "click": 1, "clickbait": 2, "coupon": 1, "crack": 1, "dating": 2, "deals": 1, "discount": 1,
    "farm": 1, "free": 1, "gratis": 1, "hot": 1, "keygen": 2, "loan": 1, "loans": 2, "lottery": 2, "meds": 2, "payday": 2, "pharmacy": 1, "pill": 2,
    "pills": 2, "popup": 1, "prize": 1, "promo": 1, "replica": 2, "seo": 1, "spam": 2, "torrent": 2, "track": 1, "tracker": 1, "tracking": 1, "win": 1, "winner": 1,
}
REJECT_AT = 3


def automaton(strict=STRICT, soft=SOFT):
    """Finds strict terms (weight 0) and soft ones; a term in both lists is strict."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, weight in ({**soft, **dict.fromkeys(strict, 0)}).items():
        out.add_word(word, (word, weight))
    out.make_automaton()
    return out


def hits(machine, text: str) -> tuple[int, int]:
    """Distinct strict terms, and the weight of the distinct soft terms, that stand between boundaries."""
    strict, soft = set(), {}
    if not len(machine):
        return 0, 0
    for last, (word, weight) in machine.iter(text):
        first = last - len(word) + 1
        before = text[first - 1] if first else ""
        after = text[last + 1] if last + 1 < len(text) else ""
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            if weight:
                soft[word] = weight
            else:
                strict.add(word)
    return len(strict), sum(soft.values())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def scanned(url: str | None) -> str:
    """What the automaton reads of a url."""
    return (unquote(url) if "%" in url else url).translate(_FOLD) if url else ""


def url_filter(df: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, reject_at: int = REJECT_AT) -> DataFrame:
    """df with host, path, rule, verdict, strict_hits and soft_weight (more underscores where df has such columns)."""
    names = {c: store.free_name(c, df.columns) for c in ("host", "path", "rule", "verdict", "strict_hits", "soft_weight")}
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    df = df.withColumn(names["host"], F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")))
    df = df.withColumn(names["path"], F.coalesce(F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0), F.lit("")))

    def run(batches):
        machine = automaton(strict, soft)
        for batch in batches:
            found = [hits(machine, scanned(u)) for u in batch.column(url).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, names["strict_hits"], names["soft_weight"]])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{names['strict_hits']}` long, `{names['soft_weight']}` long"])
    df = df.mapInArrow(run, schema)
    h, p = F.col(names["host"]), F.col(names["path"])
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        host, _, path = text.partition("/")
        fits = ((h == host) | h.endswith("." + host)) & p.startswith("/" + path)
        rule, verdict = rule.when(fits, text), verdict.when(fits, says)
    reject = (F.col(names["strict_hits"]) > 0) | (F.col(names["soft_weight"]) >= reject_at)
    return df.withColumn(names["rule"], rule).withColumn(names["verdict"], verdict.otherwise(F.when(reject, "block").otherwise("allow")))


def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


_found = "regexp_matches(hp, '(^|[^a-z0-9]){}([^a-z0-9]|$)')::bigint"
OP10_SQL = f"""
with u as (select page_id, translate(url_decode(coalesce(url, '')), '{_UPPER}', '{_LOWER}') hp, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
s as (select page_id, hp, rest, regexp_extract(rest, '^[^/?#]*') raw from u),
q as (select page_id, hp, translate(raw, '{_UPPER}', '{_LOWER}') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from s),
r as (select *, case {" ".join(f"when (host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}') then '{t}'" for t, _ in sorted(RULES, key=lambda r: -len(r[0])))} end as rule from q),
v as (select *, ({" + ".join(_found.format(w) for w in STRICT)})::bigint strict_hits, ({" + ".join(f"{n} * {_found.format(w)}" for w, n in SOFT.items())})::bigint soft_weight from r)
select page_id, host, path, rule, strict_hits, soft_weight,
  case {" ".join(f"when rule = '{t}' then '{v}'" for t, v in RULES)} when strict_hits > 0 or soft_weight >= {REJECT_AT} then 'block' else 'allow' end as verdict
from v
"""
