"""Queries: span algebra, filters, redaction, reports, links, HTML and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan import schema
from veilspan.functions import ip
from veilspan.functions import text as tx
from veilspan.functions.url import clean_url, unwrap_url
from veilspan.lists import Context
from veilspan.operators import html as hm
from veilspan.operators import report
from veilspan.operators import spans as sp
from veilspan.operators.detect import explode_spans, find_spans
from veilspan.operators.modes import add_terms, check_claims, redact
from veilspan.operators.words import explode_words
from veilspan.plans.base import FOUND, PROJECT, SPANS_SQL, derived, documents, query, rewritten, spans_of, table
from veilspan.sources import dictionaries, files, history

_CATEGORY = "case when type in ('CREDIT_CARD', 'IBAN') then 'finance' when type in ('EMAIL', 'PHONE') then 'persons' when type = 'SECRET' then 'secrets' else 'network' end"


@query("entity_counts_by_lang", FOUND + """
select d.lang, f.type, count(*) as n, count(distinct f.doc_id) as docs from found f join documents d on d.doc_id = f.doc_id group by all""")
def entity_counts_by_lang(spark, sf):
    spans = spans_of(documents(spark, sf, "lang"), keep=("doc_id", "lang"))
    # counted per text first: the distinct count needs no second shuffle of the spans
    per_doc = spans.groupBy("lang", "type", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("lang", "type").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("category_rollup", FOUND + f"""
select {_CATEGORY} as category, type, count(*) as n from found group by rollup ({_CATEGORY}, type)""")
def category_rollup(spark, sf):
    return report.category_rollup(spans_of(documents(spark, sf)), schema.category_rules(spark))


@query("summary", FOUND + " select type, count(*) as n from found group by type")
def summary(spark, sf):
    return report.summary(spans_of(documents(spark, sf)))


@query("grouped_findings", FOUND + """
select doc_id, type, lower(text) as value, min_by(text, start) as first_form, min(start) as first_start, count(*) as n from found group by all""")
def grouped_findings(spark, sf):
    return report.grouped_findings(spans_of(documents(spark, sf)), "doc_id")


@query("label_counts", FOUND + """
select quality, toxic, type, cast(sum(c) as bigint) as n, count(*) as docs from (select doc_id, type, count(*) as c from found group by all) f
join labels using (doc_id) group by all""")
def label_counts(spark, sf):
    return report.label_counts(spans_of(documents(spark, sf)), table(spark, sf, "labels"))


@query("quality", FOUND + """
select type, count(*) as tp, cast(0 as bigint) as fp, cast(0 as bigint) as fn, 1.0::double as precision, 1.0::double as recall, 1.0::double as f1
from (select distinct doc_id, type, text from found where type in ('PHONE', 'SECRET')) group by type""")
def quality(spark, sf):
    """Found against a gold table; the gold rows come from plain patterns over the same texts."""
    docs = documents(spark, sf)
    found = spans_of(docs, "phone", "kv-secrets").select("doc_id", "type", "text")
    gold = docs.select("doc_id", F.lit("PHONE").alias("type"), F.explode(F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), F.lit(0))).alias("text"))
    keys = docs.select("doc_id", F.lit("SECRET").alias("type"), F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))).alias("text"))
    return report.quality(found, gold.unionByName(keys))


# ---------------------------------------------------------------- filters
@query("filtered_findings", SPANS_SQL + " where type not in ('PHONE', 'EMAIL') and text <> '227.5.221.1'")
def filtered_findings(spark, sf):
    """Types that are off, types that are kept, allowed terms."""
    ctx = Context(disabled_types=("PHONE",), type_modes={"EMAIL": "keep"}, allow_terms=("227.5.221.1",))
    return spans_of(documents(spark, sf), ctx=ctx).select("doc_id", "start", "end", "type", "text")


@query("size_guard", """
select doc_id, case when length(text) > 5000 then 'text too large (' || length(text) || ' chars), skipped' end as warning from documents""")
def size_guard(spark, sf):
    found = find_spans(documents(spark, sf), detectors=("email",), ctx=Context(max_chars=5000))
    return found.select("doc_id", F.get("warnings", F.lit(0)).alias("warning"))


@query("allowed_ranges", FOUND + """
select doc_id, text, cast(split_part(text, '.', 1) as integer) < 128 as allowed from found where type = 'IPV4'""")
def allowed_ranges(spark, sf):
    from veilspan.operators.detect import ip_allowed

    rows = spans_of(documents(spark, sf), "ipv4").select("doc_id", "text")
    return rows.withColumn("allowed", ip_allowed(F.col("text"), Context(allow_ip_ranges=("0.0.0.0/1",))))


@query("allowed_domains", """
select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
 regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\\.)example\\.(com|org|net)$') as allowed from pages""")
def allowed_domains(spark, sf):
    from veilspan.functions.url import url_host
    from veilspan.operators.detect import domain_allowed

    hosts = table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    return hosts.withColumn("allowed", domain_allowed(F.col("host"), Context()))


# ---------------------------------------------------------------- span algebra
_WORDS3 = """with w as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+|[^0-9]+')) as t, generate_subscripts(regexp_extract_all(text, '[0-9]+|[^0-9]+'), 1) as i from documents),
p as (select doc_id, t, cast(sum(length(t)) over (partition by doc_id order by i) - length(t) as integer) as s from w),
n as (select doc_id, s, t from p where regexp_matches(t, '^[0-9]+$'))"""


def _number_spans(text, parts):
    """Findings over digit runs, as (lead to skip, length or NULL for the rest, priority)."""
    from veilspan.functions.regex import finding, hits, join_findings

    return join_findings(*[
        F.transform(_longer(hits(text, "[0-9]+"), least), _cutter(skip, size, prio, finding)) for skip, size, prio, least in parts])


def _longer(found, least):
    return F.filter(found, lambda h: F.length(h["text"]) >= least)


def _cutter(skip, size, prio, finding):
    def cut(h):
        value = F.substring(h["text"], F.lit(skip + 1), F.length(h["text"]) if size is None else F.lit(size))
        return finding(h["start"] + skip, value, "CUSTOM", "numbers", prio)

    return cut


@query("resolve_by_priority", _WORDS3 + """
select doc_id, s as start, cast(s + case when length(t) >= 4 then 2 else length(t) end as integer) as "end" from n where length(t) >= 2""")
def resolve_by_priority(spark, sf):
    """Whole digit runs (priority 10) against their first two digits of long runs (20)."""
    both = _number_spans(F.col("text"), [(0, None, 10, 2), (0, 2, 20, 4)])
    return _resolved(documents(spark, sf), both, "priority")


@query("resolve_by_length", _WORDS3 + """
select doc_id, s as start, cast(s + length(t) as integer) as "end" from n where length(t) >= 2""")
def resolve_by_length(spark, sf):
    both = _number_spans(F.col("text"), [(0, None, 10, 2), (0, 2, 20, 4), (1, 1, 30, 3)])
    return _resolved(documents(spark, sf), both, "length")


def _resolved(docs, spans, order):
    chosen = docs.select("doc_id", sp.resolve(spans, order).alias("spans"))
    return explode_spans(chosen, "doc_id").select("doc_id", "start", "end")


@query("redact_documents", rewritten("'[REDACTED]'") + " select doc_id, output from o")
def redact_documents(spark, sf):
    return redact(documents(spark, sf)).select("doc_id", "output")


@query("redact_by_type", rewritten("'<' || type || '>'") + " select doc_id, output from o")
def redact_by_type(spark, sf):
    return redact(documents(spark, sf), "<{type}>").select("doc_id", "output")


@query("replacement_rows", FOUND + """
select doc_id, type, text as original, start as in_start, cast(start + coalesce(sum(length('<' || type || '>') - length(text)) over (partition by doc_id order by start
 rows between unbounded preceding and 1 preceding), 0) as integer) as out_start from found""")
def replacement_rows(spark, sf):
    out = redact(documents(spark, sf), "<{type}>")
    return out.select("doc_id", F.inline_outer("replacements")).where("type is not null").select("doc_id", "type", "original", "in_start", "out_start")


@query("output_offsets", FOUND + """
select doc_id, start, cast(start + coalesce(sum(10 - length(text)) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) as integer) as out_start,
 cast(start + 10 + coalesce(sum(10 - length(text)) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) as integer) as out_end from found""")
def output_offsets(spark, sf):
    reps = spans_of(documents(spark, sf)).select("doc_id", "start", F.col("text").alias("original"), F.lit("[REDACTED]").alias("replacement"))
    return report.output_offsets(reps).select("doc_id", "start", "out_start", "out_end")


@query("blank_spans", rewritten("repeat('•', length(original))") + " select doc_id, output from o")
def blank_spans(spark, sf):
    found = find_spans(documents(spark, sf))
    return found.select("doc_id", sp.blank(F.col("text"), F.col("spans")).alias("output"))


@query("highlight_spans", """
with d as (select doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as t, text from documents)
select doc_id, regexp_replace(t, '([0-9]{16})', '<span class="hit" title="CUSTOM">\\1</span>', 'g') as html from d where regexp_matches(text, '[0-9]{16}')""")
def highlight_spans(spark, sf):
    from veilspan.functions.regex import findings, hits

    docs = documents(spark, sf).where(F.regexp_like("text", F.lit("[0-9]{16}")))
    marked = findings(hits(F.col("text"), "[0-9]{16}"), "CUSTOM", "numbers", 50)
    return docs.select("doc_id", sp.highlight(F.col("text"), marked).alias("html"))


@query("spans_outside", FOUND + " select doc_id, start from found where type <> 'EMAIL'")
def spans_outside(spark, sf):
    found = find_spans(documents(spark, sf))
    mails = F.filter("spans", lambda s: s["type"] == "EMAIL")
    return explode_spans(found.select("doc_id", sp.outside(F.col("spans"), mails).alias("spans")), "doc_id").select("doc_id", "start")


@query("page_chunks", """
select doc_id, cast(ceil(greatest(length(text), 1) / 4000.0) as bigint) as chunks, length(text) as chars from documents""")
def page_chunks(spark, sf):
    chunks = documents(spark, sf).select("doc_id", F.explode(sp.page_chunks(F.array("text"), 4000)).alias("c"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("c.text")).alias("chars"))


@query("counts_map", FOUND + """
select d.doc_id, (select count(*) from found f where f.doc_id = d.doc_id and f.type = 'IPV4') as ips from documents d""")
def counts_map(spark, sf):
    out = redact(documents(spark, sf))
    return out.select("doc_id", F.coalesce(F.try_element_at(report.counts_map(F.col("replacements")), F.lit("IPV4")), F.lit(0)).cast("bigint").alias("ips"))


@query("distinct_replacements", FOUND + " select type, text as original, '<' || type || '>' as replacement, count(*) as n from found group by all")
def distinct_replacements(spark, sf):
    rows = redact(documents(spark, sf), "<{type}>").select(F.inline_outer("replacements")).where("type is not null")
    return report.distinct_replacements(rows)


@query("leftovers", """
select doc_id, 'ab' || cast(doc_id as varchar) as original from documents where doc_id % 2 = 0""")
def leftovers(spark, sf):
    """Replaced values that are still in the output: here every second text keeps one."""
    value = F.expr("'ab' || cast(doc_id as string)")
    rep = F.array(F.struct(value.alias("original")), F.struct(F.lit("zz").alias("original")))
    docs = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit(" "), F.upper(value), F.lit("."))).otherwise(
        F.concat(F.col("text"), F.lit(" "), value, F.lit("x zz"))).alias("output"), rep.alias("replacements"))
    return report.leftovers(docs)


@query("leftovers_after_redaction", "select cast(0 as bigint) as n")
def leftovers_after_redaction(spark, sf):
    return report.leftovers(redact(documents(spark, sf))).agg(F.count("*").alias("n"))


@query("tracking_apart", """
select event_id % 10 as grp, cast(count(*) as bigint) as tracking, cast(count(*) as bigint) as others from events group by 1""")
def tracking_apart(spark, sf):
    docs = derived(spark, sf, "events", "event_id", "'https://example.com/p?id=1&utm_source=' || md5(props) || ' from 10.0.' || cast(user_id as string) || '.7'")
    rows = redact(docs, detectors=("tracking", "ipv4")).select((F.col("doc_id") % 10).alias("grp"), F.inline_outer("replacements")).where("type is not null")
    return report.tracking_apart(rows, "grp")


@query("output_claims", "select c_custkey as doc_id, c_name as claim from customer where c_custkey % 3 <> 0")
def output_claims(spark, sf):
    customers = table(spark, sf, "customer")
    docs = customers.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Dear "), "c_name").alias("text"))
    claims = customers.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array("c_name", F.lit("Nobody"))).alias("claim"))
    safe = customers.where("c_custkey % 3 = 0").select(F.col("c_name").alias("value"))
    return check_claims(docs, claims, safe)


@query("leftover_terms", "select c_name as term from customer union select p_name from part")
def leftover_terms(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct().select(
        "term", F.lit("").alias("type"), F.lit("").alias("replacement"), F.lit(False).alias("regex"), F.lit(False).alias("case_sensitive"))
    return add_terms(terms, table(spark, sf, "customer").select(F.col("c_name").alias("original"))).select("term")


# ---------------------------------------------------------------- links and HTML
@query("clean_url", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(url, '([?&])utm_[^&#]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&](#|$)', '\1') as clean from pages""")
def clean_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", clean_url(F.col("url")).alias("clean"))


@query("unwrap_url", "select page_id, case when page_id % 2 = 0 then url end as target from pages")
def unwrap_urls(spark, sf):
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.google.com/url?sa=t&url="), F.url_encode("url"), F.lit("&ved=2"))).otherwise(
        F.concat(F.lit("https://example.org/url?q="), F.url_encode("url")))
    return table(spark, sf, "pages").select("page_id", unwrap_url(wrapped).alias("target"))


_HIDE = r"""regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)(<style\b[^>]*>).*?(</style\s*>)', '\1\2', 'g')"""
_BLOCKS = "|".join(hm.BLOCK_TAGS)


@query("html_visible_text", rf"""
with h as (select page_id, {_HIDE} as m from pages),
t as (select page_id, regexp_replace(regexp_replace(m, '(?i)</?\s*(?:{_BLOCKS})(?:[\s/][^<>]*)?>', chr(10), 'g'), '(?s)<![^>]*>|</?[A-Za-z][^<>]*>', '', 'g') as v from h)
select page_id, replace(replace(replace(replace(replace(replace(v, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as text from t""")
def html_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", hm.visible_text(F.col("html")).alias("text"))


@query("html_redact", """
select page_id, '<p>Mail <b>[REDACTED]</b> or <a title="[REDACTED]" class="x@acme-test.de" href="/p' || page_id || '">there &amp; now</a></p>' as output from pages""")
def html_redact(spark, sf):
    """A value split over tags, a value in an attribute, comments and formatting attributes."""
    pages = table(spark, sf, "pages").select("page_id", F.concat(
        F.lit('<p><!-- a@acme-test.de -->Mail <b>mia@ac</b>me-test.de or <a title="mia@acme-test.de" class="x@acme-test.de" href="/p'),
        F.col("page_id").cast("string"), F.lit('">there &amp; now</a></p>')).alias("html"))
    return hm.process_html(pages, lambda t: redact(t, detectors=("email",)), doc_id="page_id").select("page_id", "output")


@query("clipboard_header", "select page_id, html as data from pages")
def clipboard_header(spark, sf):
    head = "Version:0.9\r\nStartHTML:{:010d}\r\nEndHTML:0000099999\r\n"
    prefix = head.format(len(head.format(0)))
    return table(spark, sf, "pages").select("page_id", hm.strip_clipboard_header(F.concat(F.lit(prefix), "html")).alias("data"))


# ---------------------------------------------------------------- history, files, dictionaries, settings
_EVENT_HISTORY = "select 'p' || cast(user_id % 5 as varchar) as project, event_id as id, ts, row_number() over (partition by user_id % 5 order by ts desc, event_id desc) as r from events"


@query("history_latest", f"select project, id from ({_EVENT_HISTORY}) where r <= 25")
def history_latest(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("'p' || cast(user_id % 5 as string)").alias("project"), F.col("event_id").alias("id"), "ts")
    return history.latest(rows, 25).select("project", "id")


@query("history_masked", rewritten("repeat('•', length(original))") + " select doc_id as id, output as input from o")
def history_masked(spark, sf):
    result = redact(documents(spark, sf))
    return history.entries(result, PROJECT, "redact", "job", store_originals=False).select("id", "input")


@query("history_removed", "select event_id as id from events where event_id % 7 <> 0")
def history_removed(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return history.remove(rows, rows.where("id % 7 = 0"))


@query("findings_json", FOUND + """
select doc_id, '{"start":' || start || ',"end":' || (start + length(text)) || ',"type":"' || type || '","text":"' || text || '","detector":"ipv4"}' as json from found where type = 'IPV4'""")
def findings_json(spark, sf):
    return files.findings_json(find_spans(documents(spark, sf), detectors=("ipv4",)))


@query("decode_files", "select doc_id, 'cp1252' as encoding, text from documents where regexp_matches(text, '[à-ÿ]') and not regexp_matches(text, '[^\\x00-\\xff]') "
       "union all select doc_id, 'utf-8', text from documents where not (regexp_matches(text, '[à-ÿ]') and not regexp_matches(text, '[^\\x00-\\xff]'))")
def decode_files(spark, sf):
    """Bytes of unknown encoding: texts with Latin-1 letters are written as such, the rest as UTF-8."""
    latin = F.regexp_like("text", F.lit("[à-ÿ]")) & ~F.regexp_like("text", F.lit("[^\u0000-ÿ]"))
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return documents(spark, sf).select("doc_id", raw.alias("b")).select("doc_id", F.inline(F.array(files.decode_bytes(F.col("b"))))).select(
        "doc_id", "encoding", "text")


@query("output_names", "select p_partkey, 'in/' || p_name || '.pseudo.md' as name from part")
def output_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", files.output_name(F.expr("'in/' || p_name || '.md'"), "pseudonymize").alias("name"))


@query("parse_terms", "select c_name as term, 'ORG' as type, c_mktsegment as replacement from customer")
def parse_terms(spark, sf):
    lines = table(spark, sf, "customer").select(F.expr("' ' || c_name || ' |org| ' || c_mktsegment").alias("value"))
    return files.parse_terms(lines)


@query("layered_settings", """
select p_name as key, coalesce(max(p_brand) filter (where p_size % 4 = 3), max(p_brand) filter (where p_size % 4 = 2), max(p_brand) filter (where p_size % 4 = 1), max(p_brand)) as value
from (select distinct on (p_name, p_size % 4) p_name, p_size, p_brand from part order by p_name, p_size % 4, p_partkey) group by p_name""")
def layered_settings(spark, sf):
    layer = F.element_at(F.array(*[F.lit(x) for x in ("default", "machine", "user", "policy")]), (F.col("p_size") % 4 + 1).cast("int"))
    one = table(spark, sf, "part").groupBy(F.col("p_name").alias("key"), layer.alias("layer")).agg(F.min_by("p_brand", "p_partkey").alias("value"))
    return files.layered(one)


@query("merged_lists", """
select 'terms' as list_name, value, min(place) as place from (select p_brand as value, 1 as place from part union all select c_mktsegment, 0 from customer) group by value""")
def merged_lists(spark, sf):
    base = table(spark, sf, "part").select(F.lit("terms").alias("list_name"), F.col("p_brand").alias("value"))
    return files.merged_list(base, table(spark, sf, "customer").select(F.lit("terms").alias("list_name"), F.col("c_mktsegment").alias("value")))


@query("build_dictionary", """
with w as (select lang, unnest(regexp_extract_all(lower(text), '[a-zà-ɏß]{2,}')) as word from documents), c as (select lang, word, count(*) as n from w group by all)
select lang, word, n, cast(r as integer) as rank from (select *, row_number() over (partition by lang order by n desc, encode(word)) as r from c) where r <= 200""")
def build_dictionary(spark, sf):
    return dictionaries.build_dictionary(documents(spark, sf, "lang"), 200)


@query("common_words", """
select p_partkey, lower(split_part(p_name, ' ', 2)) || 's' as word from part where p_partkey % 3 = 0
union all select p_partkey, upper(split_part(p_name, ' ', 2)) from part where p_partkey % 3 = 1""")
def common_words(spark, sf):
    """Plurals and any case count, other words do not; the dictionary are the words of the part names."""
    parts = table(spark, sf, "part")
    known = parts.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("word")).distinct()
    rows = parts.select("p_partkey", F.expr(
        "case p_partkey % 3 when 0 then lower(split_part(p_name, ' ', 2)) || 's' when 1 then upper(split_part(p_name, ' ', 2)) else 'zz' || p_name end").alias("word"))
    return dictionaries.common_words(rows, "word", known).select("p_partkey", "word")


@query("place_names", "select lower(n_name) as phrase from nation where regexp_matches(lower(n_name), '^[a-z]{2,}( [a-z]+)*$') union select lower(r_name) || ' am main' from region")
def place_names(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.array().cast("array<string>").alias("alternates"), F.lit("XX").alias("country"), F.lit(1000).alias("population"))
    more = table(spark, sf, "region").select(F.concat("r_name", F.lit("-am/Main")).alias("name"), F.array().cast("array<string>").alias("alternates"), F.lit("XX").alias("country"), F.lit(5).alias("population"))
    return dictionaries.place_dictionary(names.unionByName(more), ("XX",), 1)


@query("first_names", "select distinct 'zoé' || lower(substr(c_mktsegment, 1, 3)) as raw, 'zoe' || lower(substr(c_mktsegment, 1, 3)) as name from customer")
def first_names(spark, sf):
    rows = table(spark, sf, "customer").select(F.expr("'Zoé' || lower(substr(c_mktsegment, 1, 3))").alias("name")).distinct()
    folded = dictionaries.first_name_dictionary(rows)
    return rows.select(F.lower("name").alias("raw"), tx.fold_accents(F.col("name")).alias("name")).join(folded, "name", "left_semi").select("raw", "name")


@query("text_words", """
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_À-ɏ]+')) as words from documents""")
def text_words(spark, sf):
    return explode_words(documents(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("words"))


# ---------------------------------------------------------------- scalar functions
@query("checksums", """
select c_custkey, true as iban_ok, true as luhn_ok, false as luhn_bad from customer""")
def checksums(spark, sf):
    from veilspan.plans.detection import IBAN

    body = F.expr("'4' || lpad(cast(c_custkey as string), 14, '7')")
    digit = tx.luhn_digit(body)
    wrong = ((digit.cast("int") + 1) % 10).cast("string")
    return table(spark, sf, "customer").select("c_custkey", tx.iban_ok(F.expr(IBAN)).alias("iban_ok"), tx.luhn_ok(F.concat(body, digit)).alias("luhn_ok"),
                                               tx.luhn_ok(F.concat(body, wrong)).alias("luhn_bad"))


@query("transfer_case", """
select p_partkey, case p_partkey % 3 when 0 then upper(p_name) when 1 then lower(p_name) else upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) end as out from part""")
def transfer_case(spark, sf):
    sample = F.element_at(F.array(F.lit("ABC"), F.lit("abc"), F.lit("Abc")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tx.transfer_case(sample, F.col("p_name")).alias("out"))


@query("slugs", "select n_nationkey, replace(lower(n_name), ' ', '-') || '-2024' as slug from nation")
def slugs(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", tx.slugify(F.concat(F.lit(" "), "n_name", F.lit(" / 2024! "))).alias("slug"))


@query("ip_classes", FOUND + """
select text, case when a in (0, 127) or a >= 240 then null when a = 10 then 'private' when a between 224 and 239 then 'multicast' when a = 172 and b between 16 and 31 then 'private'
 when a = 192 and b = 168 then 'private' when a = 100 and b between 64 and 127 then 'cgnat' when a = 169 and b = 254 then 'linklocal' when a = 198 and b in (18, 19) then 'benchmark' else 'public' end as label
from (select distinct text, cast(split_part(text, '.', 1) as integer) as a, cast(split_part(text, '.', 2) as integer) as b from found where type = 'IPV4')""")
def ip_classes(spark, sf):
    ips = spans_of(documents(spark, sf), "ipv4").select("text").distinct()
    return ips.select("text", ip.ip_class(F.col("text")).alias("label"))


@query("entropy_bits", """
with c as (select p_partkey, p_name, unnest(string_split(p_name, '')) as ch from part), g as (select p_partkey, p_name, ch, count(*) as k from c group by all)
select p_partkey, round(-sum((k / length(p_name)) * log2(k / length(p_name))), 6) as bits from g group by p_partkey""")
def entropy_bits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(tx.entropy(F.col("p_name")), 6).alias("bits"))


@query("json_in_text", "select event_id, replace(props, ' ', '') as props from events")
def json_in_text(spark, sf):
    text = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))
    return table(spark, sf, "events").select("event_id", F.replace(tx.first_json(text), F.lit(" "), F.lit("")).alias("props"))


@query("event_times", "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at from events")
def event_times(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.format_epoch(F.unix_timestamp("ts")).alias("at"))


@query("base64_round_trip", "select c_custkey, c_name as back from customer")
def base64_round_trip(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.b64_decode(tx.b64_encode(F.col("c_name"), True)).alias("back"))


@query("text_hashes", "select doc_id, sha256(text) as h from documents")
def text_hashes(spark, sf):
    return documents(spark, sf).select("doc_id", tx.text_hash(F.col("text")).alias("h"))
