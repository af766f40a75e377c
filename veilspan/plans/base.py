"""Registry of queries: each runs over whole driver tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.tables import deal_rows, fill_cores
from veilspan.lists import Context
from veilspan.operators import detectors as registry
from veilspan.operators.detect import explode_spans, find_spans

KEY = "an example key, take it from a secret store in a job"
PROJECT = "audit"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return fill_cores(table(spark, sf, "documents").select("doc_id", "text", *columns))


def derived(spark: SparkSession, sf: str, name: str, key: str, text: str) -> DataFrame:
    """Texts made from a table by an SQL expression that Spark and DuckDB read alike."""
    rows = table(spark, sf, name)
    dealt = fill_cores(rows) if name == "documents" else deal_rows(rows)
    return dealt.selectExpr(f"cast({key} as bigint) as doc_id", f"{text} as text")


def spans_of(docs: DataFrame, *detectors: str, ctx: Context | None = None, keep=("doc_id",)) -> DataFrame:
    return explode_spans(find_spans(docs, detectors=detectors or None, ctx=ctx), *keep)


def found_rows(docs: DataFrame, *detectors: str, ctx: Context | None = None) -> DataFrame:
    return spans_of(docs, *detectors, ctx=ctx).select("doc_id", "start", "end", "type", "text")


DEFAULTS = tuple(d.id for d in registry.BUILTIN if d.default)

# ---------------------------------------------------------------- SQL: findings of the documents table
# A text is cut into runs of a character class and the gaps between them; running lengths are offsets.
_PIECES = """
{name}_t as (select doc_id, regexp_extract_all(text, '{pattern}') as parts from documents),
{name}_u as (select doc_id, unnest(parts) as tok, generate_subscripts(parts, 1) as i from {name}_t),
{name} as (select doc_id, i, tok, cast(sum(length(tok)) over (partition by doc_id order by i) - length(tok) as integer) as pos,
  lag(tok) over (partition by doc_id order by i) as prev, lead(tok) over (partition by doc_id order by i) as nxt from {name}_u)"""


def pieces(name: str, pattern: str) -> str:
    return _PIECES.format(name=name, pattern=pattern)


_LUHN = """list_sum(list_transform(range(1, length(tok) + 1), lambda k: case when k % 2 = 1 then cast(substr(tok, length(tok) - k + 1, 1) as integer)
  else case when 2 * cast(substr(tok, length(tok) - k + 1, 1) as integer) > 9 then 2 * cast(substr(tok, length(tok) - k + 1, 1) as integer) - 9
  else 2 * cast(substr(tok, length(tok) - k + 1, 1) as integer) end end)) % 10 = 0"""
_OCT = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FOUND = (
    "with " + pieces("mail", r"[\p{L}\p{N}_.+%@-]+|[^\p{L}\p{N}_.+%@-]+") + ","
    + pieces("quad", r"[\p{L}\p{N}_.]+|[^\p{L}\p{N}_.]+") + ","
    + pieces("num", r"[0-9]+|[^0-9]+") + ","
    + pieces("tel", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|[^+]+|\+") + ","
    + pieces("kv", r"token = \"[0-9a-f]{40}\"|[^t]+|t") + rf""",
found as (
 select doc_id, pos as start, 'EMAIL' as type, regexp_extract(tok, '^([A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,63}})\.?$', 1) as text
  from mail where regexp_matches(tok, '^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,63}}\.?$')
 union all
 select doc_id, pos, 'IPV4', rtrim(tok, '.') from quad where regexp_matches(tok, '^{_OCT}(?:\.{_OCT}){{3}}\.?$')
 union all
 select doc_id, pos, 'CREDIT_CARD', tok from num where length(tok) between 13 and 19 and regexp_matches(tok, '^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)')
  and coalesce(prev, '') not like '%-' and coalesce(nxt, '') not like '-%' and {_LUHN}
 union all
 select doc_id, pos, 'PHONE', tok from tel where length(tok) = 17 and tok like '+1 (%'
 union all
 select doc_id, pos + 9, 'SECRET', substr(tok, 10, 40) from kv where length(tok) = 50 and tok like 'token = %')""")
SPANS_SQL = FOUND + " select doc_id, start, cast(start + length(text) as integer) as \"end\", type, text from found"


def one_type(typ: str) -> str:
    return SPANS_SQL + f" where type = '{typ}'"


# rewriting a text from its spans
def rewritten(replacement: str) -> str:
    return FOUND + f""",
s as (select f.doc_id, f.start, cast(f.start + length(f.text) as integer) as e, f.type, f.text as original, {replacement} as rep,
  coalesce(lag(f.start + length(f.text)) over (partition by f.doc_id order by f.start), 0) as prev from found f),
w as (select s.doc_id, string_agg(substr(d.text, cast(prev + 1 as integer), cast(start - prev as integer)) || rep, '' order by start) as head, max(e) as last
  from s join documents d on d.doc_id = s.doc_id group by s.doc_id),
o as (select d.doc_id, d.text, coalesce(w.head || substr(d.text, w.last + 1), d.text) as output from documents d left join w on w.doc_id = d.doc_id)
"""


__all__ = ["F", "QUERIES", "Query", "query"]
