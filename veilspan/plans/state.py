"""Queries: mappings, surrogates, round trips, layout tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import ip
from veilspan.functions import text as tx
from veilspan.functions.tables import cut, spread, shared_folder
from veilspan.lists import Context
from veilspan.operators import boxes as bx
from veilspan.operators import modes, report
from veilspan.operators import surrogates as su
from veilspan.operators.detect import find_spans
from veilspan.plans.base import FOUND, KEY, PROJECT, documents, query, spans_of, table
from veilspan.plans.detection import IBAN
from veilspan.sources.state import State, decrypt_rows, encrypt_rows
from veilspan.sources.state_log import StateLog
from veilspan.streaming import watch as st

# ---------------------------------------------------------------- dictionary joins
_TERMS = "select distinct lower(regexp_extract(text, '[A-Za-z]{4,}')) as term from benchmark"
_TOKENS = "with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_À-ɏ]+')) as word from documents)"


@query("dictionary_occurrences", f"""
{_TOKENS} select lower(word) as term, count(distinct doc_id) as docs, count(*) as hits from w where lower(word) in ({_TERMS}) group by 1""")
def dictionary_occurrences(spark, sf):
    """Whole-word hits of a dictionary, which is small enough to be a literal."""
    return _occurrences(spark, sf)


@query("dictionary_join", f"""
{_TOKENS} select lower(word) as term, count(distinct doc_id) as docs, count(*) as hits from w where lower(word) in ({_TERMS}) group by 1""")
def dictionary_join(spark, sf):
    """The same by a salted shuffle join, as a dictionary of many millions takes it."""
    return _occurrences(spark, sf, inline_limit=0, broadcast_limit=0)


def _occurrences(spark, sf, **limits):
    terms = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)).alias("term")).distinct()
    return report.occurrences_by_term(documents(spark, sf), terms.withColumn("ci", F.lit(True)), **limits)


# ---------------------------------------------------------------- mappings and round trips
def _pseudonymized(spark, sf) -> tuple[DataFrame, State]:
    return modes.pseudonymize(documents(spark, sf), State.empty(spark), PROJECT, KEY)


@query("pseudonymize_roundtrip", "select doc_id, text from documents")
def pseudonymize_roundtrip(spark, sf):
    out, state = _pseudonymized(spark, sf)
    back = modes.revert(cut(out.select("doc_id", F.col("output").alias("text"))), state, PROJECT, KEY)
    return back.select("doc_id", F.col("output").alias("text"))


@query("revert_by_join", "select doc_id, text from documents")
def revert_by_join(spark, sf):
    """The same with the mapping as a table that is joined, not as a literal."""
    out, state = _pseudonymized(spark, sf)
    back = modes.revert(cut(out.select("doc_id", F.col("output").alias("text"))), state, PROJECT, KEY, inline_limit=0)
    return back.select("doc_id", F.col("output").alias("text"))


@query("pseudonymized_texts", FOUND + """
select d.doc_id, (select count(*) from found f where f.doc_id = d.doc_id) as replaced, length(d.text) - (select coalesce(sum(length(f.text)), 0) from found f where f.doc_id = d.doc_id) as kept from documents d""".replace("length(d.text) - (select coalesce(sum(length(f.text)), 0) from found f where f.doc_id = d.doc_id)", "cast(length(d.text) - (select coalesce(sum(length(f.text)), 0) from found f where f.doc_id = d.doc_id) as bigint)"))
def pseudonymized_texts(spark, sf):
    """How much of every text was replaced; all findings are, apart from addresses that are never mapped."""
    out, _state = _pseudonymized(spark, sf)
    size = F.aggregate("replacements", F.lit(0), lambda a, r: a + F.length(r["original"]))
    return out.select("doc_id", F.size("replacements").cast("bigint").alias("replaced"), (F.length("text") - size).cast("bigint").alias("kept"))


@query("mapping_usage", FOUND + """
select type, text as original, count(*) as count from found where not (type = 'IPV4' and (try_cast(split_part(text, '.', 1) as integer) >= 240 or try_cast(split_part(text, '.', 1) as integer) in (0, 127))) group by all""")
def mapping_usage(spark, sf):
    _out, state = _pseudonymized(spark, sf)
    return state.mappings.where("count > 0").select("type", "original", "count")


@query("mapping_properties", FOUND + """
select type, count(distinct text) as originals, count(distinct text) as surrogates, cast(0 as bigint) as unchanged, cast(0 as bigint) as other_length from found
 where not (type = 'IPV4' and (try_cast(split_part(text, '.', 1) as integer) >= 240 or try_cast(split_part(text, '.', 1) as integer) in (0, 127))) group by type""")
def mapping_properties(spark, sf):
    """Unique, changed, and of the same length where the format asks for it."""
    _out, state = _pseudonymized(spark, sf)
    fixed = F.col("type").isin("CREDIT_CARD", "PHONE", "SECRET")
    return state.mappings.where("count > 0").groupBy("type").agg(
        F.count("*").alias("originals"), F.countDistinct("surrogate").alias("surrogates"),
        F.count_if(F.col("original") == F.col("surrogate")).alias("unchanged"),
        F.count_if(fixed & (F.length("original") != F.length("surrogate"))).alias("other_length"))


@query("mapping_overview", FOUND + """
select 'EMAIL' as type, count(distinct text) as n from found where type = 'EMAIL'""")
def mapping_overview(spark, sf):
    _out, state = _pseudonymized(spark, sf)
    return state.search(PROJECT, "@", "EMAIL").groupBy("type").agg(F.count("*").alias("n"))


@query("state_round_trip", """
select 'mappings' as kind, true as same union all select 'networks', true union all select 'placeholders', true union all select 'token_map', true""")
def state_round_trip(spark, sf):
    """Export as JSON, encrypt, decrypt, import: the same rows."""
    _out, state = _pseudonymized(spark, sf)
    key = F.unhex(F.sha2(F.lit(KEY), 256))
    back = State.from_json(decrypt_rows(encrypt_rows(state.to_json(PROJECT), key), key))
    parts = []
    for name in ("mappings", "token_map", "networks", "placeholders"):
        a = getattr(state, name).select(F.to_json(F.struct("*")).alias("row"), F.lit(1).alias("d"))
        b = getattr(back, name).select(F.to_json(F.struct(*getattr(state, name).columns)).alias("row"), F.lit(-1).alias("d"))
        wrong = a.union(b).groupBy("row").agg(F.sum("d").alias("d")).where("d <> 0")
        parts.append(wrong.agg((F.count("*") == 0).alias("same")).select(F.lit(name).alias("kind"), "same"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("shared_originals", FOUND + """
select distinct type, text as original from found where type in ('PHONE', 'CREDIT_CARD')""")
def shared_originals(spark, sf):
    rows = spans_of(documents(spark, sf), "phone", "creditcard", "ipv4").select("type", F.col("text").alias("original"))
    one = rows.withColumn("project", F.lit("a"))
    two = rows.where("type <> 'IPV4'").withColumn("project", F.lit("b"))
    return report.shared_originals(one.unionByName(two), "a", "b")


@query("forget_originals", FOUND + "select distinct type, text as original from found where type = 'SECRET'")
def forget_originals(spark, sf):
    """Rows of a project without the ones that were to be forgotten."""
    rows = spans_of(documents(spark, sf), "phone", "kv-secrets").select("type", F.col("text").alias("original")).distinct()
    mappings = rows.select(F.lit(PROJECT).alias("project"), "type", "original", F.sha2("original", 256).alias("surrogate"),
                           F.lit(1).cast("bigint").alias("count"), F.current_timestamp().alias("first_seen"), F.current_timestamp().alias("last_seen"))
    empty = State.empty(spark)
    state = State(cut(mappings), empty.token_map, empty.networks, empty.placeholders)
    return state.drop(PROJECT, keys=rows.where("type = 'PHONE'")).mappings.select("type", "original")


@query("surrogate_networks", FOUND + """
select distinct 4 as version, split_part(text, '.', 1) || '.' || split_part(text, '.', 2) || '.' || split_part(text, '.', 3) || '.0/24' as cidr from found
 where type = 'IPV4'""")
def surrogate_networks(spark, sf):
    """Networks around addresses (here of the originals: the rule does not depend on the key)."""
    rows = spans_of(documents(spark, sf), "ipv4").select(F.col("text").alias("surrogate"))
    return su.networks_of(rows).select("version", "cidr")


@query("placeholder_numbering", FOUND + """,
firsts as (select type, text, min(struct_pack(doc := doc_id, start := start)) as first from found group by all)
select doc_id, start, f.type, '<' || f.type || '_' || r.n || '>' as mark from found f
join (select type, text, row_number() over (partition by type order by first) as n from firsts) r on r.type = f.type and r.text = f.text""")
def placeholder_numbering(spark, sf):
    out, _state = modes.placeholders(documents(spark, sf), State.empty(spark), PROJECT, KEY)
    rows = out.select("doc_id", F.inline_outer("replacements")).where("type is not null")
    return rows.select("doc_id", F.col("in_start").alias("start"), "type", F.col("replacement").alias("mark"))


@query("anonymized_texts", FOUND + """
select d.doc_id, (select count(*) from found f where f.doc_id = d.doc_id and f.type <> 'IPV4') as replaced from documents d""")
def anonymized_texts(spark, sf):
    out = modes.anonymize(documents(spark, sf), ctx=Context(type_modes={"IPV4": "keep"}))
    return out.select("doc_id", F.size("replacements").cast("bigint").alias("replaced"))


@query("pseudonymised_hint", FOUND + """
select doc_id, type <> '' as looks, cast(0 as bigint) as real from (select f.doc_id, min(f.type) as type from found f where f.type <> 'IPV4' group by f.doc_id)""")
def pseudonymised_hint(spark, sf):
    """Processed texts are recognised as such (texts with a strong surrogate)."""
    out, state = _pseudonymized(spark, sf)
    strong = out.where(F.exists("replacements", lambda r: r["type"] != "IPV4"))
    docs = cut(strong.select("doc_id", F.col("output").alias("text")))
    rows = modes.hint(docs, state, PROJECT, KEY)
    other = F.filter("real_findings", lambda s: s["type"] != "IPV4")
    return rows.select("doc_id", F.col("looks_pseudonymised").alias("looks"), F.size(other).cast("bigint").alias("real"))


@query("names_across_texts", """
select c_custkey as doc_id, 'mia.falk' || substr(translate(md5(c_name), '0123456789', 'ghijklmnop'), 1, 6) || '@acme-test.de' as original from customer where c_custkey % 2 = 0""")
def names_across_texts(spark, sf):
    """What one text teaches (an address) translates a name in another text of the project, and both come back."""
    last = F.expr("'falk' || substr(translate(md5(c_name), '0123456789', 'ghijklmnop'), 1, 6)")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), last.alias("last")).where("doc_id % 2 = 0")
    mails = rows.select("doc_id", F.concat(F.lit("an mia."), "last", F.lit("@acme-test.de")).alias("text"))
    out, state = modes.pseudonymize(mails, State.empty(spark), PROJECT, KEY, detectors=("email",))
    out = cut(out.select("doc_id", "output", F.get("replacements", F.lit(0)).alias("r")))
    notes = rows.select("doc_id", F.concat(F.lit("Notiz Mia "), F.initcap("last")).alias("text")).distinct()
    named, state = modes.pseudonymize(notes, state, PROJECT, KEY, detectors=("email",), scope="project")
    named = cut(named.select("doc_id", "text", "output", F.transform("replacements", lambda r: F.lower(r["replacement"])).alias("names")))
    both = out.select((F.col("doc_id") * 2).alias("doc_id"), F.col("output").alias("text")).unionByName(
        named.select((F.col("doc_id") * 2 + 1).alias("doc_id"), F.col("output").alias("text")))
    back = cut(modes.revert(both, state, PROJECT, KEY).select(F.expr("doc_id div 2").alias("doc_id"), (F.col("doc_id") % 2 == 1).alias("note"), "output"))
    restored = back.where("not note").select("doc_id", F.regexp_extract("output", r"\S+@\S+", 0).alias("restored"))
    read = back.where("note").select("doc_id", F.col("output").alias("read"))
    # the names of the note became those of the address' surrogate
    taught = F.split(F.substring_index("r.replacement", "@", 1), r"\.")
    same = (F.size("names") == 2) & F.startswith(F.get("names", F.lit(0)), F.get(taught, F.lit(0))) & F.startswith(F.get("names", F.lit(1)), F.get(taught, F.lit(1)))
    return out.select("doc_id", "r").join(restored, "doc_id").where("r.original = restored").join(named, "doc_id").join(read, "doc_id").where(
        same & (F.col("read") == F.col("text"))).select("doc_id", F.col("r.original").alias("original"))


# ---------------------------------------------------------------- surrogates by type
@query("ip_map_properties", """
select user_id, event_id, true as back, true as same_class, true as same_net from events""")
def ip_map_properties(spark, sf):
    """Bijective, class kept, hosts of one network stay together."""
    key = F.lit(KEY)
    rows = table(spark, sf, "events").select("user_id", "event_id", F.expr("'10.' || cast(user_id % 200 as string) || '.' || cast(event_id % 250 as string) || '.' || cast(event_id % 13 + 7 as string)").alias("a"))
    mapped = spread(rows.select("a").distinct(), "a").withColumn("m", ip.map_ip(F.col("a"), key)).withColumn("u", ip.unmap_ip(F.col("m"), key)).withColumn(
        "c", ip.ip_class(F.col("a")) == ip.ip_class(F.col("m"))).withColumn("net", F.substring_index("a", ".", 3))
    nets = mapped.groupBy("net").agg((F.countDistinct(F.substring_index("m", ".", 3)) == 1).alias("same_net"))
    checked = cut(mapped.join(nets, "net").select("a", (F.col("u") == F.col("a")).alias("back"), F.col("c").alias("same_class"), "same_net"))
    return rows.join(checked, "a").select("user_id", "event_id", "back", "same_class", "same_net")


@query("ipv6_map_properties", "select event_id, true as back, true as same_class from events")
def ipv6_map_properties(spark, sf):
    key = F.lit(KEY)
    rows = table(spark, sf, "events").select("event_id", F.expr("'2a02:8100:' || lower(hex(user_id + 1)) || '::' || lower(hex(event_id + 300))").alias("a"))
    mapped = spread(rows, "a").withColumn("m", ip.map_ip(F.col("a"), key))
    return mapped.select("event_id", (ip.unmap_ip(F.col("m"), key) == F.col("a")).alias("back"),
                         (ip.ip_class(F.col("a")) == ip.ip_class(F.col("m"))).alias("same_class"))


@query("number_surrogates", """
select c_custkey, true as iban, true as card, true as phone, true as mac, true as sid, true as secret from customer""")
def number_surrogates(spark, sf):
    """Formats stay valid: check digits, country, layout, vendor part, account number, prefix."""
    seed = tx.keyed_hash(F.lit(KEY), F.col("c_name"))
    rows = spread(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_name", F.expr(IBAN).alias("iban"), F.expr("'4' || lpad(cast(c_custkey as string), 14, '7')").alias("body"))
    rows = rows.withColumn("card", F.concat("body", tx.luhn_digit(F.col("body")))).withColumn("phone", F.expr("'+49 (0)30 ' || lpad(cast(c_custkey as string), 7, '4')")).withColumn(
        "mac", F.expr("'02:AA:BB:0C:1D:' || upper(lpad(hex(c_custkey % 256), 2, '0'))")).withColumn("sid", F.expr("'S-1-5-21-1-2-' || cast(c_custkey as string) || '-1001'")).withColumn(
        "secret", F.expr("'gl' || 'pat-' || md5(c_name)"))
    new = rows.select("*", su.iban_surrogate(F.col("iban"), seed).alias("i2"), su.card_surrogate(F.col("card"), seed).alias("k2"), su.phone_surrogate(F.col("phone"), seed).alias("p2"),
                      su.mac_surrogate(F.col("mac"), seed).alias("m2"), su.sid_surrogate(F.col("sid"), F.lit(KEY)).alias("s2"), tx.randomize_chars(F.col("secret"), seed, 6).alias("t2"))
    return new.select(
        "c_custkey", (tx.iban_ok(F.col("i2")) & (F.left("i2", F.lit(2)) == "DE") & (F.col("i2") != F.col("iban"))).alias("iban"),
        (tx.luhn_ok(F.col("k2")) & (F.left("k2", F.lit(1)) == "4") & (F.length("k2") == 16)).alias("card"),
        F.regexp_like("p2", F.lit(r"^\+49 \(0\)\d\d \d{7}$")).alias("phone"),
        F.regexp_like("m2", F.lit("^02:AA:BB(?::[0-9A-F]{2}){3}$")).alias("mac"),
        F.regexp_like("s2", F.lit(r"^S-1-5-21-\d{9,10}-\d{9,10}-\d{9,10}-1001$")).alias("sid"),
        (F.regexp_like("t2", F.lit("^gl" + "pat-[0-9a-z]{32}$")) & (F.col("t2") != F.col("secret"))).alias("secret"))


# ---------------------------------------------------------------- layout tables from line items
def _rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_quantity").cast("int").alias("q"))


@query("box_union", """
select l_orderkey as doc_id, cast(l_orderkey % 3 as integer) as page, min(cast(l_suppkey as double)) - 0.6 as x0, max(cast(l_suppkey + l_quantity as double)) + 0.6 as x1, count(*) as chars
from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) group by l_orderkey""")
def box_union(spark, sf):
    """Boxes of the characters a span covers, one per page and line."""
    one = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m"))
    chars = one.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") % 3).cast("int").alias("page"), F.lit(1).alias("line"),
                       F.col("m.l_suppkey").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("m.l_suppkey") + F.col("m.l_quantity")).cast("double").alias("x1"), F.lit(1.0).alias("y1"))
    spans = one.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_linenumber").alias("start"), (F.max("l_linenumber") + 1).alias("end")).withColumn("type", F.lit("CUSTOM")).withColumn("text", F.lit("x"))
    counted = bx.overlap_join(spans, chars.withColumn("e", F.col("pos") + 1), ["doc_id"], ("start", "end"), ("pos", "e")).groupBy("doc_id").agg(F.count("*").alias("chars"))
    return bx.text_boxes(spans, chars).join(counted, "doc_id").select("doc_id", "page", "x0", "x1", "chars")


@query("box_margin", """
select l_orderkey as image_id, l_linenumber as line, cast(greatest(0, l_suppkey - pad) as bigint) as x, cast(least(1000, l_suppkey + q + pad) - greatest(0, l_suppkey - pad) as bigint) as w
from (select *, cast(l_quantity as integer) as q, greatest(3, cast(round_even(0.2 * greatest(l_quantity, 10), 0) as integer)) as pad from lineitem)""")
def box_margin(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("x"), F.lit(50).cast("bigint").alias("y"),
                                               F.col("l_quantity").cast("int").alias("w"), F.lit(10).alias("h"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return bx.add_margin(rows, 20, 3).select("image_id", "line", F.col("x").cast("bigint").alias("x"), F.col("w").cast("bigint").alias("w"))


@query("box_merge", """
select l_orderkey as image_id, cast(min(l_linenumber * 10) as double) as y, cast(max(l_linenumber * 10) + 8 - min(l_linenumber * 10) as double) as h
from (select *, sum(case when gap > 1 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber) as g from
 (select *, l_linenumber - lag(l_linenumber, 1, l_linenumber) over (partition by l_orderkey order by l_linenumber) as gap from (select distinct l_orderkey, l_linenumber from lineitem)))
group by l_orderkey, g""".replace("+ 8 -", "+ 12 -"))
def box_merge(spark, sf):
    """Touching boxes become one: lines 10 apart and 12 high touch, a missing line is a gap."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.col("l_orderkey").alias("image_id"), F.lit("TEXT").alias("kind"), F.lit("black").alias("effect"), F.lit(5).alias("x"),
        (F.col("l_linenumber") * 10).alias("y"), F.lit(20).alias("w"), F.lit(12).alias("h"), F.lit("").alias("label"))
    return bx.merge_boxes(rows).select("image_id", "y", "h")


@query("box_best", """
select l_orderkey as image_id, max(s) as score from (select l_orderkey, l_linenumber, max(round(l_discount + l_tax, 2)) as s from lineitem group by all) group by l_orderkey""")
def box_best(spark, sf):
    """Detections of one place: the best score stays."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord")).agg(
        F.max(F.round(F.col("l_discount") + F.col("l_tax"), 2)).alias("score")).select(
        "image_id", F.lit("FACE").alias("kind"), "ord", "score", F.lit(10).alias("x"), F.lit(10).alias("y"), F.lit(50).alias("w"), F.lit(50).alias("h"))
    return bx.best_boxes(rows).select("image_id", "score")


@query("box_overlaps", """
with b as (select l_orderkey as image_id, l_linenumber as ord, 20 * l_linenumber as x, max(round(l_discount + l_tax, 2)) as score from lineitem group by all),
p as (select *, ord - lag(ord, 1, -9) over (partition by image_id order by ord) > 1 as new from b)
select image_id, cast(count(*) as bigint) as boxes from (select image_id, ord, row_number() over (partition by image_id, g order by ord) as k from
 (select *, sum(case when new then 1 else 0 end) over (partition by image_id order by ord) as g from p)) where k % 2 = 1 group by image_id""")
def box_overlaps(spark, sf):
    """Boxes 60 wide, 20 apart, score falling: a box is dropped for its neighbour (overlap 1/2), not for the next but one (1/5)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord")).distinct().select(
        "image_id", F.lit("FACE").alias("kind"), "ord", (-F.col("ord")).cast("double").alias("score"), (20 * F.col("ord")).alias("x"), F.lit(0).alias("y"), F.lit(60).alias("w"), F.lit(50).alias("h"))
    return bx.best_boxes(rows).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))


@query("box_images", """
select doc_id, page, x1 from (select distinct l_orderkey as doc_id, l_linenumber as page, least(round(l_quantity, 1), 100.0) as x1, l_suppkey as px from lineitem)
where x1 * 50 / 10000 >= 0.01 and least(px, 60) >= 48 group by all""")
def box_images(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(100.0).alias("page_w"), F.lit(100.0).alias("page_h"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        F.col("l_quantity").alias("x1"), F.lit(50.0).alias("y1"), F.col("l_suppkey").cast("int").alias("width"), F.lit(60).alias("height"))
    return bx.usable_images(rows).select("doc_id", "page", "x1")


@query("box_word_lines", """
select page_id as image_id, string_agg(w, case when i % 2 = 0 then ' ' else '  ' end order by i) as text from
(select page_id, unnest(['ab', 'cd', 'ef', 'gh']) as w, unnest([0, 1, 2, 3]) as i from pages) group by page_id""".replace("string_agg(w, case when i % 2 = 0 then ' ' else '  ' end order by i)", "'ab  cd ef  gh'"))
def box_word_lines(spark, sf):
    """Blanks come back from the gaps between words of 10 per character."""
    word = F.inline(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x")) for t, x in (("ab", 0), ("cd", 40), ("ef", 70), ("gh", 110))]))
    words = table(spark, sf, "pages").select(F.col("page_id").alias("image_id"), F.lit(1).alias("line"), word).withColumn("w", F.lit(20))
    return bx.line_texts(bx.word_lines(words)).select("image_id", "text")


@query("box_ocr", "select page_id as image_id, 2 as line, 40 as x, 20 as w, 'cd' as label from pages")
def box_ocr(spark, sf):
    """A span in the second of two lines: the word it touches is covered."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("image_id"))
    lines = pages.select("image_id", F.inline(F.array(*[F.struct(F.lit(n).alias("line"), F.lit("ab cd").alias("text"), F.lit(0).alias("x"), F.lit(10 * n).alias("y"), F.lit(60).alias("w"), F.lit(8).alias("h"), F.lit(6 * (n - 1)).alias("start")) for n in (1, 2)])))
    words = lines.select("image_id", "line", F.inline(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(s + 2).alias("e"), F.lit(x).alias("x"), F.lit(12).alias("y"), F.lit(20).alias("w"), F.lit(6).alias("h")) for s, x in ((0, 0), (3, 40))])))
    spans = pages.select("image_id", F.lit(9).alias("start"), F.lit(11).alias("end"), F.lit("CUSTOM").alias("type"))
    return bx.ocr_boxes(spans, lines, words).select("image_id", "line", "x", "w", "label")


@query("box_document_text", """
select l_orderkey as doc_id, string_agg(cast(l_linenumber % 10 as varchar) || chr(10), '' order by l_linenumber) || chr(10) as text from (select distinct l_orderkey, l_linenumber from lineitem) group by l_orderkey""")
def box_document_text(spark, sf):
    chars = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("line"), F.lit(1).alias("pos"), (F.col("l_linenumber") % 10).cast("string").alias("ch"))
    return bx.document_text(chars)


# ---------------------------------------------------------------- streams
FILES, FILES_AT_ONCE = 16, 4


def _stream(spark, rows: DataFrame, name: str, last: DataFrame | None = None, files: int | None = FILES, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """The rows as a file stream in the folder for checkpoints (a stand-in for a topic): files in order of
    time (without ``files`` as the rows lie), several micro-batches. ``last`` rows come in a file of their own behind the others."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for frame in (rows if files is None else rows.repartitionByRange(files, "ts"), last):
        if frame is not None:
            frame.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(folder)
            names = (s.getPath().getName() for s in fs.listStatus(path))
            parts += sorted(n for n in names if n.startswith("part-") and n not in parts)
    for k, part in enumerate(parts):  # a file source goes by their time, which tasks side by side leave to chance
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(path, part), 1_700_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(folder)


def _finished(spark, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run an available-now stream to its end and return what its sink holds."""
    root = shared_folder(spark)
    unique = f"{name}_{uuid.uuid4().hex}"
    if mode == "complete":
        def replace(batch: DataFrame, _id: int) -> None:  # every batch has the whole result
            batch.write.mode("overwrite").parquet(f"{root}/{unique}")

        stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{root}/{unique}-c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/{unique}")
    out = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{root}/{unique}-c").option("path", f"{root}/{unique}").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/{unique}")


def _events(spark, sf):
    return table(spark, sf, "events").select("ts", "user_id", F.col("event_type").alias("type"))


@query("windowed_counts", """
select time_bucket(interval '5 minutes', ts) as window_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as window_end, event_type as type, count(*) as n from events group by all""")
def windowed_counts(spark, sf):
    return st.windowed_counts(_events(spark, sf))


@query("sliding_counts", """
select time_bucket(interval '5 minutes', ts) - i * interval '5 minutes' as window_start, event_type as type, count(*) as n from events, (select unnest([0, 1]) as i) group by all""")
def sliding_counts(spark, sf):
    return st.windowed_counts(_events(spark, sf), "10 minutes", "5 minutes").select("window_start", "type", "n")


@query("session_counts", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '10 minutes' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval '10 minutes' as session_end, count(*) as n from s group by user_id, k""")
def session_counts(spark, sf):
    return st.session_counts(_events(spark, sf))


@query("stream_counts", """
select time_bucket(interval '1 hour', ts) as window_start, event_type as type, count(*) as n from events group by all""")
def stream_counts(spark, sf):
    """The windowed counts as a stream over files, run until all rows are taken."""
    stream = _stream(spark, _events(spark, sf), "events", at_once=FILES)
    return _finished(spark, st.windowed_counts(stream, "1 hour"), "stream_counts", "complete").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "type", "n")


_WATCH = """case event_id % 6 when 0 then 'see https://example.com/?utm_source=a and 10.0.0.7' when 1 then 'mail eva.lindt@zeta-test.de' when 2 then 'gl' || 'pat-' || substr(md5(props), 1, 20)
 when 3 then 'nothing here' when 4 then 'see https://example.com/?id=1&gclid=7' else 'aGVsbG8gd29ybGQ=' end"""
_DECISION = "case event_id % 6 when 0 then 'auto' when 1 then 'ask' when 2 then 'lone_secret' when 3 then 'none' when 4 then 'auto' else 'base64' end"


def _watch_events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), "ts", F.expr(_WATCH).alias("text"))


@query("watch_decisions", f"""
select event_id, {_DECISION} as decision, case when event_id % 6 in (0, 4) then 1 else 0 end as autos, case when event_id % 6 in (0, 1, 2) then 1 else 0 end as asks from events""")
def watch_decisions(spark, sf):
    out = st.watch(_watch_events(spark, sf))
    return out.select("event_id", "decision", F.size("auto_spans").alias("autos"), F.size("ask_spans").alias("asks"))


@query("stream_decisions", f"select {_DECISION} as decision, count(*) as n from events group by 1")
def stream_decisions(spark, sf):
    stream = _stream(spark, _watch_events(spark, sf), "watch", at_once=FILES)
    done = _finished(spark, st.watch(stream).select("event_id", "decision"), "stream_decisions")
    return done.groupBy("decision").agg(F.count("*").alias("n"))


@query("stream_settled", """
with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 seconds' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select 'u' || cast(user_id as varchar) as source_id, max(ts) as ts, max_by(""" + _WATCH + """, struct_pack(a := ts, b := """ + _WATCH + """)) as text from s join events using (event_id, user_id, ts) group by user_id, k""")
def stream_settled(spark, sf):
    """As a stream over files: sessions close when the watermark has passed them, so later rows follow."""
    events = _watch_events(spark, sf)
    last = events.agg(F.max("event_id").alias("event_id"), F.lit("end").alias("source_id"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("text"))
    stream = _stream(spark, events, "settled", last.coalesce(1))
    return _finished(spark, st.settle(stream, "30 seconds"), "stream_settled").where("source_id <> 'end'").select("source_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "text")


def _secrets(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"), "ts", F.sha2(F.col("event_id").cast("string"), 256).alias("h"),
        F.when(F.col("event_id") % 3 == 0, "lone_secret").otherwise("none").alias("decision"))


@query("expired_secrets", """
with e as (select user_id, ts, event_id % 3 = 0 as secret, lead(ts) over (partition by user_id order by ts) as nxt, max(ts) over () as now from events)
select kind, count(*) as n from (
 select 'scheduled' as kind from e where secret union all
 select 'clear' from e where secret and coalesce(nxt, now) >= ts + interval '60 seconds') group by kind""")
def expired_secrets(spark, sf):
    """Custom state with event-time timers; each secret is a text of its own. A last text is cleared when the
    watermark (the newest time) has passed its deadline."""
    rows = _secrets(spark, sf)
    with st.rocksdb(spark):
        return _finished(spark, st.expire_secrets(_stream(spark, rows, "secrets")), "expired").groupBy("kind").agg(F.count("*").alias("n"))


@query("expired_out_of_order", """
with e as (select user_id, ts, event_id, event_id % 3 = 0 as secret, lead(ts) over (partition by user_id order by ts) as nxt from events)
select 'u' || cast(user_id as varchar) as source_id, sha256(cast(event_id as varchar)) as h, 'scheduled' as kind from e where secret
union all select 'u' || cast(user_id as varchar), sha256(cast(event_id as varchar)), 'clear' from e where secret and (nxt is null or nxt >= ts + interval '60 seconds')""")
def expired_out_of_order(spark, sf):
    """The same with files that come in an order by chance, one per micro-batch: rows wait until the watermark has passed them."""
    rows = _secrets(spark, sf)
    span = rows.agg(F.ceil((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000)).first()[0] or 0
    mixed = rows.withColumn("ts", F.col("ts").cast("timestamp")).repartition(4, F.col("h"))
    last = rows.agg(F.lit("end").alias("source_id"), (F.max("ts") + F.make_interval(secs=F.lit(2 * span + 3600))).alias("ts"), F.lit("").alias("h"), F.lit("none").alias("decision"))
    stream = _stream(spark, mixed, "mixed", last.coalesce(1), files=None, at_once=1)
    with st.rocksdb(spark):
        return _finished(spark, st.expire_secrets(stream, late=f"{span} seconds"), "mixed").where("source_id <> 'end'").select("source_id", "h", "kind")


# ---------------------------------------------------------------- continuous pseudonymisation
_MAIL = "'mail user' || cast(user_id as varchar) || '@zeta-test.de'"


def _run_mail_stream(spark, sf, root: str) -> None:
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("source_id"), "ts", F.concat(F.lit("mail user"), F.col("user_id").cast("string"), F.lit("@zeta-test.de")).alias("text"))
    stream = _stream(spark, events, "mails", files=2, at_once=1)
    ctx = Context()
    for attempt in range(2):
        found = find_spans(stream, detectors=("email",), ctx=ctx).withColumns(
            {"h": tx.text_hash(F.col("text")), "auto_spans": F.col("spans"), "decision": F.lit("auto")})
        st.pseudonymize_stream(found, PROJECT, KEY, f"{root}/state", f"{root}/out", f"{root}/history", f"{root}/check", ctx).awaitTermination()
        if not attempt:  # as if the job had died before it could note that the last batch is done
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/check/commits")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            last = max((s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().isdigit()), key=int)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, last), False)


@query("stream_usage", f"""
select 'EMAIL' as type, substr({_MAIL}, 6) as original, count(*) as count, min(ts) as first_seen, max(ts) as last_seen, count(*) as outputs, count(*) as entries
from events group by user_id""")
def stream_usage(spark, sf):
    """Usage after a stream whose last batch ran twice: state, outputs and history count each text once."""
    root = f"{shared_folder(spark)}/mails-{uuid.uuid4().hex}"
    _run_mail_stream(spark, sf, root)
    state = StateLog(spark, f"{root}/state").load()
    original = F.col("replacements")[0]["original"].alias("original")
    outputs = spark.read.parquet(f"{root}/out").select(original).groupBy("original").agg(F.count(F.lit(1)).alias("outputs"))
    entries = spark.read.parquet(f"{root}/history").select(original).groupBy("original").agg(F.count(F.lit(1)).alias("entries"))
    return state.mappings.where("type = 'EMAIL'").join(outputs, "original").join(entries, "original").select(
        "type", "original", "count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "outputs", "entries")
