"""Queries at the limits: long values, dense texts, wrapped links, overrides per type, vocabulary, reports, boxes, event filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions import text as tx
from veilspan.lists import Context
from veilspan.operators import boxes as bx
from veilspan.operators import report
from veilspan.operators.detect import find_spans
from veilspan.operators.modes import redact
from veilspan.functions.tables import cut, deal_rows, shared_folder, spread
from veilspan.job import run as run_job
from veilspan.operators.detect import explode_spans
from veilspan.operators.spans import apply_spans, collect_spans
from veilspan.plans.base import FOUND, SPANS_SQL, derived, documents, query, rewritten, spans_of, table
from veilspan.streaming import watch as st

# A value of 64 to 11,600 characters, and of 102,400 now and then, in nine wrappings.
_VALUE = "repeat(part, cast(case when doc_id % 200 = 7 then 3200 else 2 + (doc_id % 20) * (doc_id % 20) end as int))"
_WRAPPED = """case doc_id % 9 when 0 then 'password = ' || {v} when 1 then 'password: "' || {v} || '"' when 2 then 'curl -u admin:' || {v} || ' https://x.example'
 when 3 then 'postgres://app:' || {v} || '@host/db' when 4 then '<password>' || {v} || '</password>' when 5 then 'mysql -u root -p' || {v} || ' db'
 when 6 then 'tool --password=' || {v} when 7 then '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {v} || chr(10) || '-----END RSA PRIVATE KEY-----'
 else 'IDENTIFIED BY ''' || {v} || '''' end""".format(v=_VALUE)


@query("long_secrets", "select doc_id, false as leaked, true as replaced from documents")
def long_secrets(spark, sf):
    """Secrets of any length: nothing of the value is left."""
    # the parts are dealt out, the texts are made of them where they are looked at
    parts = deal_rows(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("part")))
    out = redact(parts.select("doc_id", "part", F.expr(_WRAPPED).alias("text")), "<{type}>", detectors=("kv-secrets", "pem"))
    return out.select("doc_id", F.contains("output", F.substring("part", 1, 8)).alias("leaked"), (F.size("replacements") > 0).alias("replaced"))


@query("dense_text", """
select cast(l_orderkey // 8000 as bigint) as part, count(*) as n, md5(string_agg('host <IPV4> up', ' ')) as output from lineitem group by all""")
def dense_text(spark, sf):
    """Texts with some ten thousand addresses: the work per address does not grow with the text."""
    address = F.concat(F.lit("host 10."), (F.col("l_partkey") % 250).cast("string"), F.lit("."), (F.col("l_suppkey") % 250).cast("string"), F.lit(".7 up"))
    rows = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 8000).alias("part"), address.alias("a"))
    texts = spread(rows, "part").groupBy("part").agg(F.array_join(F.collect_list("a"), " ").alias("text"))
    return redact(texts, "<{type}>", detectors=("ipv4",)).select("part", F.size("replacements").cast("bigint").alias("n"), F.md5("output").alias("output"))


@query("wrapped_targets", "select page_id, false as leaked, true as marked from pages")
def wrapped_targets(spark, sf):
    """Links in up to five wrappers: what they hold is redacted like plain text."""
    link = F.concat(F.lit("https://shop.acme-test.de/p?mail=eva.lindt"), F.col("page_id").cast("string"), F.lit("@acme-test.de&iban=DE89370400440532013000&from="), F.md5("url"))
    for k in range(5):
        wrapped = F.concat(F.lit("https://www.google.com/url?sa=t&url="), F.url_encode(link), F.lit("&ved=2"))
        link = F.when(F.col("page_id") % 6 > k, wrapped).otherwise(link)
    docs = table(spark, sf, "pages").select("page_id", F.concat(F.lit("see "), link, F.lit(" now")).alias("text"))
    out = redact(docs, "<{type}>")
    leaked = F.regexp_like("output", F.lit("(?i)eva|lindt|0532013000|acme"))
    return out.select("page_id", leaked.alias("leaked"), (F.contains("output", F.lit("<EMAIL>")) & F.contains("output", F.lit("<IBAN>"))).alias("marked"))


@query("type_overrides", "select c_custkey as doc_id, true as mail, true as address, true as iban, true as phone from customer")
def type_overrides(spark, sf):
    """Redaction with a mode of its own for three types: a surrogate, an irreversible one, the text itself."""
    docs = derived(spark, sf, "customer", "c_custkey", "'mail user' || c_custkey || '@zeta-' || c_custkey || '.de at 10.1.' || (c_custkey % 200) || '.9, IBAN DE89370400440532013000, tel. +49 30 1234567'")
    ctx = Context(type_modes={"EMAIL": "pseudonymize", "IBAN": "anonymize", "PHONE": "keep"})
    out = redact(docs, "<{type}>", ctx, detectors=("email", "ipv4", "iban", "phone"))
    return out.select(
        "doc_id", (F.regexp_like("output", F.lit(r"mail [^ <]+@[^ <]+ at")) & ~F.regexp_like("output", F.lit("user[0-9]+@zeta-"))).alias("mail"),
        F.contains("output", F.lit(" at <IPV4>,")).alias("address"),
        (F.regexp_like("output", F.lit("IBAN DE[0-9]{20},")) & ~F.contains("output", F.lit("370400440532013000"))).alias("iban"),
        F.endswith("output", F.lit("tel. +49 30 1234567")).alias("phone"))


@query("infra_vocabulary", "select l_orderkey as doc_id, cast(0 as bigint) as n from lineitem group by all")
def infra_vocabulary(spark, sf):
    """Names made of vocabulary only are nobody's: no finding."""
    words = sorted(w for group in (lists.HOST_ROLES, lists.HOST_SERVICES, lists.WORKLOADS, lists.COMPONENTS, lists.OPERATIONS, lists.PRODUCTS)
                   for w in group if w.isalpha())
    pick = lambda c: F.element_at(F.split(F.lit(",".join(words)), ","), F.pmod(F.xxhash64(*c), F.lit(len(words))).cast("int") + 1)
    orders = cut(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_partkey").alias("p")))
    docs = deal_rows(orders).select(
        "doc_id", F.concat(F.lit("name: "), pick(["doc_id"]), F.lit("-"), pick(["p"]), F.lit("-"), pick(["doc_id", "p"])).alias("text"))
    return find_spans(docs, detectors=("infra-names",)).select("doc_id", F.size("spans").cast("bigint").alias("n"))


@query("unchanged_replacements", "select doc_id, text as output, cast(0 as bigint) as n from documents")
def unchanged_replacements(spark, sf):
    """A replacement that equals the original, or is none, changes nothing and is not listed."""
    found = find_spans(documents(spark, sf), detectors=("email", "phone"))
    same = F.transform("spans", lambda s: s.withField("replacement", F.when(s["type"] == "EMAIL", s["text"])))
    return found.withColumn("r", apply_spans(F.col("text"), same)).select("doc_id", "r.output", F.size("r.replacements").cast("bigint").alias("n"))


@query("top_findings", FOUND + """
select type, substr(text, 1, 12) as shown, count(*) as n from found group by type, text order by n desc, type, text limit 20""")
def top_findings(spark, sf):
    counted = spans_of(documents(spark, sf)).groupBy("type", "text").agg(F.count("*").alias("n"))
    return report.top(counted, 20, F.desc("n"), F.col("type"), F.col("text")).select("type", report.preview(F.col("text"), 12).alias("shown"), "n")


@query("approx_originals", FOUND + " select type, true as close from found group by type")
def approx_originals(spark, sf):
    spans = spans_of(documents(spark, sf))
    exact = spans.groupBy("type").agg(F.countDistinct("text").alias("n"))
    close = F.abs(F.col("originals") - F.col("n")) <= 0.2 * F.col("n") + 1
    return report.approx_originals(spans).join(exact, "type").select("type", close.alias("close"))


@query("box_totals", """
select l_orderkey as doc_id, count(distinct l_suppkey) as spans, count(*) as boxes, count(distinct l_linenumber) as pages from lineitem group by l_orderkey""")
def box_totals(spark, sf):
    first = F.row_number().over(bx.Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey")) == 1
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), first.alias("first"))
    return bx.totals(rows).select("doc_id", "spans", "boxes", "pages")


@query("char_positions", """
with c as (select distinct l_orderkey as doc_id, l_linenumber as line, l_partkey % 7 as pos from lineitem)
select doc_id, line, pos as old, cast(row_number() over (partition by doc_id order by line, pos) - 1 + dense_rank() over (partition by doc_id order by line) - 1 as integer) as pos from c""")
def char_positions(spark, sf):
    """Place of each character of a page in its text: a line break behind every line."""
    chars = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 7).alias("pos")).distinct()
    return bx.char_positions(chars.withColumn("old", F.col("pos"))).select("doc_id", "line", "old", "pos")


@query("own_events", "select event_id from events where event_id % 3 <> 0")
def own_events(spark, sf):
    """Texts that the job wrote itself are no news."""
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("source_id"), F.concat(F.col("event_id").cast("string"), "props").alias("text"))
    own = events.where("event_id % 3 = 0").select("source_id", tx.text_hash(F.col("text")).alias("h"))
    return st.without_own(events, own).select("event_id")


@query("paused_events", """
select e.event_id from events e left join (select user_id, min(ts) + interval '1 hour' as until from events where user_id % 2 = 0 group by user_id) p using (user_id)
where p.until is null or e.ts >= p.until""")
def paused_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("source_id"), "ts")
    pauses = events.where("source_id % 2 = 0").groupBy("source_id").agg((F.min("ts") + F.expr("interval 1 hour")).alias("until"))
    return st.not_paused(events, pauses).select("event_id")


@query("large_events", """
select event_id, case when length(props) > 40 then 'too_large' else 'none' end as decision from events""")
def large_events(spark, sf):
    """Texts beyond an optional maximum pass with a decision of their own."""
    events = table(spark, sf, "events").select("event_id", F.regexp_replace("props", "[^ ]", "x").alias("text"))
    return st.watch(events, max_chars=40, clear_after=0, offer_base64=False).select("event_id", "decision")


@query("collected_spans", SPANS_SQL)
def collected_spans(spark, sf):
    """Findings of single detectors, collected from rows: the same spans as in one pass."""
    docs = documents(spark, sf)
    parts = [explode_spans(find_spans(docs, detectors=d), "doc_id") for d in (("email", "ipv4", "domain"), ("creditcard", "phone", "kv-secrets", "hex-strings"))]
    return collect_spans(parts[0].unionByName(parts[1]), "doc_id").select("doc_id", F.inline("spans")).select("doc_id", "start", "end", "type", "text")


@query("job_redacts_types", rewritten("case when type in ('EMAIL', 'PHONE') then '[REDACTED]' else original end") + " select doc_id, output as text from o")
def job_redacts_types(spark, sf):
    """The job entry, from file to file, with two types only."""
    target = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    run_job(spark, "redact", f"{sf}/documents.parquet", target, types=["EMAIL", "PHONE"])
    return spark.read.parquet(target).select("doc_id", "text")


@query("job_analyzes", SPANS_SQL)
def job_analyzes(spark, sf):
    target = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    run_job(spark, "analyze", f"{sf}/documents.parquet", target)
    return spark.read.parquet(target).select("doc_id", "start", "end", "type", "text")
