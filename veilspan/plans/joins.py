"""Queries: phrases in texts, addresses in networks, names that other texts teach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.tables import cut, fill_cores, spread, union_all
from veilspan.lists import Context
from veilspan.operators import modes
from veilspan.operators import surrogates as su
from veilspan.operators import scopes
from veilspan.operators.detect import explode_spans
from veilspan.operators.phrases import with_phrases
from veilspan.plans.base import KEY, PROJECT, SPANS_SQL, derived, documents, query, table
from veilspan.sources.state import State

# ---------------------------------------------------------------- phrases
# Three kinds of phrases of each benchmark item, which overlap, and all part names.
_W, _GAP = "[A-Za-z]+", "[^A-Za-z]+"
_PIECES = ((f"^{_W}(?:{_GAP}{_W}){{2}}", 0), (f"^{_W}(?:{_GAP}{_W}){{5}}", 0), (f"^(?:{_W}{_GAP}){{2}}({_W}(?:{_GAP}{_W}){{2}})", 1))
_PHRASES = " union ".join(f"select regexp_extract(text, '{p}', {g}) as term from benchmark" for p, g in _PIECES) + " union select p_name from part"
_CHAR = "[A-Za-z0-9_À-ɏ]"
_OCCURRENCES = f"""
with recursive p as ({_PHRASES}),
hit as (select doc_id, term, string_split(text, term) as s from documents, p where term <> '' and contains(text, term)),
cuts as (select doc_id, term, s, unnest(generate_series(1, len(s) - 1)) as i from hit),
occ as (select doc_id, term, list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * length(term) as start from cuts
  where not regexp_matches(right(s[i], 1), '{_CHAR}') and not regexp_matches(left(s[i + 1], 1), '{_CHAR}'))"""
_LONGEST = _OCCURRENCES + """,
best as (select doc_id, start, max(length(term)) as n from occ group by all),
kept as (select doc_id, min(start) as start, arg_min(n, start) as n from best group by doc_id
  union all select b.doc_id, min(b.start), arg_min(b.n, b.start) from kept k join best b on b.doc_id = k.doc_id and b.start >= k.start + k.n group by b.doc_id)
select o.doc_id, cast(o.start as integer) as start, o.term from kept k join occ o on o.doc_id = k.doc_id and o.start = k.start and length(o.term) = k.n"""


def _phrases(spark, sf) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return union_all([*(items.select(F.regexp_extract("text", p, g).alias("term")) for p, g in _PIECES),
                      table(spark, sf, "part").select(F.col("p_name").alias("term"))]).where("term <> ''")


def _occurrences(spark, sf, **how) -> DataFrame:
    found = with_phrases(documents(spark, sf), _phrases(spark, sf), **how)
    return found.select("doc_id", F.inline_outer("occurrences")).where("term is not null").select("doc_id", "start", "term")


@query("phrase_occurrences", _LONGEST)
def phrase_occurrences(spark, sf):
    """Phrases that overlap and begin alike: the longest wins, by an automaton over words."""
    return _occurrences(spark, sf)


@query("phrase_join", _LONGEST)
def phrase_join(spark, sf):
    """The same by the rarest word of each phrase and a salted join, as a dictionary of any size takes it."""
    return _occurrences(spark, sf, automaton_bytes=0, broadcast_limit=0)


@query("phrase_overlaps", _OCCURRENCES + " select doc_id, cast(start as integer) as start, term from occ")
def phrase_overlaps(spark, sf):
    """All occurrences, overlapping ones too."""
    return _occurrences(spark, sf, longest=False)


# ---------------------------------------------------------------- addresses in networks
# An address per user, v4 and v6, that a first text names; a second text has a neighbour, the network and the address in it.
_NET4 = "concat('10.', cast(user_id % 200 as {s}), '.', cast(user_id // 200 % 250 as {s}), '.')"
_NET6 = "concat('2a02:8100:', cast(1000 + user_id as {s}), ':2:')"
_SECOND = "concat('from ', {a}, '9 by ', {a}, '77/24 in ', {a}, '0/24 and ', {b}, ':9 in ', {b}, ':/64')"


@query("neighbour_addresses", "select distinct user_id as doc_id, " + _SECOND.format(a=_NET4.format(s="varchar"), b=_NET6.format(s="varchar")) + " as text, 0 as exact from events")
def neighbour_addresses(spark, sf):
    """Addresses that were never mapped come back if their network is known: neighbours, prefixes, networks, v4 and v6."""
    a, b = (e.format(s="string").replace("//", "div") for e in (_NET4, _NET6))
    users = table(spark, sf, "events").select("user_id").distinct()
    first = fill_cores(users.selectExpr("user_id as doc_id", f"concat('host ', {a}, '7 and ', {b}, ':7') as text"))
    state = modes.pseudonymize(first, State.empty(spark), PROJECT, KEY, detectors=("ipv4", "ipv6"))[1]
    pieces = users.select(F.col("user_id").alias("doc_id"), F.posexplode(F.split(F.expr(_SECOND.format(a=a, b=b)), " ")).alias("i", "original"))
    typ = F.when(F.contains("original", F.lit(":")), "IPV6").when(F.contains("original", F.lit(".")), "IPV4").otherwise("").alias("type")
    known = cut(spread(pieces.select("original", typ).distinct(), "original").select(
        "original", "type", F.lit("").alias("as_type"), F.lit(0).alias("keep_prefix")).withColumn(
        "surrogate", F.when(F.col("type") == "", F.col("original")).otherwise(su.ip_surrogate(F.col("original"), F.lit(KEY), Context(), (4, 6)))))
    mapped = pieces.join(known, "original").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).alias("p")).select(
        "doc_id", F.array_join(F.transform("p", lambda x: x["surrogate"]), " ").alias("text"))
    mapped = cut(mapped)
    exact = known.where("type <> ''").join(state.mappings.select("surrogate").distinct(), "surrogate", "left_semi").count()
    back = modes.revert(mapped, state, PROJECT, KEY).select("doc_id", F.col("output").alias("text"))
    return back.withColumn("exact", F.lit(exact).cast("int"))


# ---------------------------------------------------------------- names across texts, slices of a text
_LAST = "'falk' || substr(translate(md5(c_name), '0123456789', 'ghijklmnop'), 1, 6)"
_LETTER = f"""'an mia.' || {_LAST} || '@acme-test.de'"""
_TITLE = f"""'Bericht Mia ' || upper(substr({_LAST}, 1, 1)) || substr({_LAST}, 2) || ' und {{}}'"""


def _titled(spark, sf) -> DataFrame:
    """A title and a body per customer, texts of their own in one scope; the body has the address."""
    parts = [derived(spark, sf, "customer", f"2 * c_custkey + {k}", text).withColumn("scope", F.expr("doc_id div 2")) for k, text in enumerate((
        _TITLE.format("Falkner"), _LETTER))]
    return union_all(parts)


@query("titles_by_body", f"""
with t as (select 2 * c_custkey as doc_id, {_LAST} as name from customer)
select cast(doc_id as bigint) as doc_id, 8 as start, 'Mia' as text, 'first' as kind from t union all
select cast(doc_id as bigint), 12, upper(substr(name, 1, 1)) || substr(name, 2), 'last' from t""")
def titles_by_body(spark, sf):
    """Names in titles are known from the bodies' addresses, those of other documents are not."""
    found = scopes.find_spans_in_scope(_titled(spark, sf), "scope", ("email", "learned-names"))
    spans = explode_spans(found, "doc_id").where("type = 'PERSON'")
    return spans.select("doc_id", "start", "text", F.try_element_at("meta", F.lit("kind")).alias("kind"))


@query("names_of_project", f"select cast(c_custkey as bigint) as doc_id, {_TITLE.format('Falkner')} as text, 2 as replaced from customer")
def names_of_project(spark, sf):
    """What letters taught the project in one run is replaced in titles of the next, and comes back."""
    letters = derived(spark, sf, "customer", "c_custkey", _LETTER)
    state = modes.pseudonymize(letters, State.empty(spark), PROJECT, KEY, detectors=("email",))[1]
    titles = derived(spark, sf, "customer", "c_custkey", _TITLE.format("Falkner"))
    out, state = modes.pseudonymize(titles, state, PROJECT, KEY, detectors=("email",), scope="project")
    out = cut(out.select("doc_id", "output", F.size("replacements").alias("replaced")))
    back = modes.revert(out.select("doc_id", F.col("output").alias("text")), state, PROJECT, KEY)
    return back.join(out.select("doc_id", "replaced"), "doc_id").select("doc_id", F.col("output").alias("text"), "replaced")


@query("sliced_spans", SPANS_SQL)
def sliced_spans(spark, sf):
    """All findings, each text cut into slices of 2,000 characters that are tasks' rows of their own."""
    found = scopes.find_spans_sliced(documents(spark, sf), size=2000, overlap=300)
    return found.select("doc_id", F.inline_outer("spans")).where("start is not null").select("doc_id", "start", "end", "type", "text")
