"""Queries: functions for SQL users, own detectors that may fail, own surrogates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veilspan import sql
from veilspan.functions import text as tx
from veilspan.functions.tables import cut
from veilspan.lists import Context
from veilspan.operators import detectors as registry
from veilspan.operators import modes
from veilspan.operators.detect import find_spans
from veilspan.operators.detectors import Detector, python_detector
from veilspan.plans.base import FOUND, KEY, PROJECT, SPANS_SQL, derived, documents, query, rewritten
from veilspan.sources.state import State


# ---------------------------------------------------------------- SQL
@query("sql_find_spans", SPANS_SQL)
def sql_find_spans(spark, sf):
    """All findings by a table function in a lateral join."""
    sql.register_functions(spark)
    documents(spark, sf).createOrReplaceTempView("veilspan_texts")
    return spark.sql("select d.doc_id, s.start, s.`end`, s.type, s.text from veilspan_texts d, lateral find_spans(d.text) s")


@query("sql_redact_text", rewritten("'<' || type || '>'") + " select doc_id, output from o")
def sql_redact_text(spark, sf):
    sql.register_functions(spark, Context(redact_template="<{type}>"))
    documents(spark, sf).createOrReplaceTempView("veilspan_texts")
    return spark.sql("select doc_id, redact_text(text) as output from veilspan_texts")


# ---------------------------------------------------------------- detectors that fail
def _fragile(text, _ctx):
    """Throws on texts with a phone number."""
    return F.transform(F.array(text), lambda t: F.when(
        F.contains(t, F.lit("+1 (")), F.raise_error(F.lit("no such texts")).cast("string")).otherwise(t)).cast("array<string>")


def _first_word(text):
    if "@" in text:
        raise ValueError("no such texts")
    return [(0, 3, "CUSTOM")] if text.startswith("The") else []


@query("failing_detectors", FOUND + """
select d.doc_id, (select count(*) from found f where f.doc_id = d.doc_id and f.type = 'EMAIL') as mails,
 case when d.text like 'The%' and d.text not like '%@%' then 1 else 0 end as words,
 array_to_string(list_filter([case when d.text like '%+1 (%' then 'detector fragile failed, skipped' end, case when d.text like '%@%' then 'detector words failed, skipped' end,
  'detector broken failed, skipped', 'term is no valid pattern, skipped: (x'], lambda w: w is not null), '; ') as warnings
from documents d""")
def failing_detectors(spark, sf):
    """Three detectors that fail, on some texts or on all, and a bad pattern: warnings, while the others go on."""
    def broken(_text, _ctx):
        raise RuntimeError("not built")

    nothing = Detector("fragile", ("CUSTOM",), 1, lambda t, c: F.transform(F.filter(_fragile(t, c), lambda x: F.lit(False)), lambda x: F.lit(None).cast(
        "struct<start:int,end:int,type:string,text:string,detector:string,priority:int,meta:map<string,string>>")), guarded=True)
    own = (nothing, python_detector("words", ("CUSTOM",), 1, _first_word), Detector("broken", ("CUSTOM",), 1, broken, guarded=True))
    for detector in own:
        registry.register(detector)
    try:
        out = find_spans(documents(spark, sf), ("email", "custom", *(d.id for d in own)), ctx=Context(custom_terms=({"term": "(x", "regex": True},)))
    finally:
        for detector in own:
            registry.unregister(detector.id)
    count = lambda detector: F.size(F.filter("spans", lambda s: s["detector"] == detector))
    return out.select("doc_id", count("email").cast("bigint").alias("mails"), count("words").alias("words"), F.array_join("warnings", "; ").alias("warnings"))


# ---------------------------------------------------------------- own surrogates
_TICKET = "'ticket TCK-' || cast(c_custkey as string) || ' of ' || c_name"


def _reference(original, key, attempt):
    """REF and three digits: fewer values than originals may need, so that numbers run out."""
    return F.concat(F.lit("REF-"), F.substring(tx.keyed_hash(key, F.lit("ticket"), original, F.lit(attempt)), 1, 3))


@query("own_surrogates", f"select cast(c_custkey as bigint) as doc_id, {_TICKET.replace('string', 'varchar')} as text, true as shaped, cast(1 as bigint) as holders from customer")
def own_surrogates(spark, sf):
    """An own type with an own generator: its shape is kept, no surrogate is given twice, texts come back."""
    registry.register(python_detector("tickets", ("TICKET",), 90, _tickets))
    docs = derived(spark, sf, "customer", "c_custkey", _TICKET)
    try:
        out, state = modes.pseudonymize(docs, State.empty(spark), PROJECT, KEY, Context(generators={"TICKET": _reference}), detectors=("tickets",))
    finally:
        registry.unregister("tickets")
    out = cut(out.select("doc_id", "output", "replacements"))
    back = modes.revert(out.select("doc_id", F.col("output").alias("text")), state, PROJECT, KEY).select("doc_id", F.col("output").alias("text"))
    holders = state.mappings.groupBy("surrogate").agg(F.count(F.lit(1)).alias("holders"))
    own = out.select("doc_id", F.get("replacements", F.lit(0))["replacement"].alias("surrogate"))
    shaped = F.regexp_like("surrogate", F.lit("^REF-[0-9a-f]{3}(-[0-9a-f]+)?$"))
    return back.join(own, "doc_id").join(holders, "surrogate").select("doc_id", "text", shaped.alias("shaped"), "holders")


def _tickets(text):
    return [(m.start(), m.end(), "TICKET") for m in re.finditer(r"TCK-[0-9]+", text)]
