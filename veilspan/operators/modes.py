"""What is done with findings: redact, anonymise, pseudonymise, revert, and the hint for revert."""

from __future__ import annotations

import secrets as _random
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import ip
from veilspan.functions import text as tx
from veilspan.functions.regex import empty, finding, hits, let
from veilspan.functions.tables import cut, lookup, spread
from veilspan.functions.url import clean_url
from veilspan.lists import Context
from veilspan.operators import words as wd
from veilspan.operators import detectors as registry
from veilspan.operators.detect import domain_allowed, explode_spans, find_spans, raw_spans
from veilspan.operators.detectors import network
from veilspan.operators.spans import apply_spans, outside, resolve
from veilspan.operators.surrogates import _session_cached, assign, number_placeholders
from veilspan.schema import CASE_INSENSITIVE_TYPES, CATEGORY_OF, FINDING, FINDINGS, IP_TYPES
from veilspan.sources.state import State

REPLACED = FINDING.replace("meta:map<string,string>>", "meta:map<string,string>,replacement:string>")


def _with_replacement(span: Column, value: Column) -> Column:
    return span.withField("replacement", value)


def redact_text(span: Column, template: str) -> Column:
    """The template with ``{type}``; any other placeholder in it makes the plain mark."""
    try:
        template.format(type="X")
    except (KeyError, IndexError, ValueError):
        return F.lit("[REDACTED]")
    head, *rest = template.replace("{{", "\0").replace("}}", "\1").split("{type}")
    parts = [F.lit(head.replace("\0", "{").replace("\1", "}"))]
    for piece in rest:
        parts += [span["type"], F.lit(piece.replace("\0", "{").replace("\1", "}"))]
    return F.concat(*parts)


def _mode_of(span: Column, mode: str, ctx: Context) -> Column:
    out = F.lit(mode)
    for typ, m in ctx.type_modes.items():
        out = F.when(span["type"] == typ, m).otherwise(out)
    return out


def _unwrapped(span: Column) -> Column:
    return F.try_element_at(span["meta"], F.lit("unwrap"))


def _apply(docs: DataFrame, spans: str, text: str) -> DataFrame:
    done = docs.withColumn("_r", apply_spans(F.col(text), F.col(spans)))
    return done.withColumn("output", F.col("_r.output")).withColumn("replacements", F.col("_r.replacements")).drop("_r", spans)


def redact(docs: DataFrame, template: str | None = None, ctx: Context | None = None, text: str = "text", detectors=None,
           state: State | None = None, project: str = "redact", key: str | None = None, doc_id: str = "doc_id",
           types: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``output``, ``replacements``, ``warnings``. One projection over the table; with ``types``
    only findings of these.

    What stands behind redirect wrappers is detected and redacted like the text itself. Types with a
    mode of their own that needs surrogates (``ctx.type_modes``) get them from ``state`` and ``key``,
    or irreversible ones without; ``doc_id`` has to be unique then.
    """
    ctx = ctx or Context()
    ctx = replace(ctx, redact_template=template or ctx.redact_template)
    if types is not None:
        ctx = replace(ctx, disabled_types=(*ctx.disabled_types, *(t for t in CATEGORY_OF if t not in types)))
    if {"pseudonymize", "anonymize"} & set(ctx.type_modes.values()):
        return pseudonymize(docs, state or State.empty(docs.sparkSession), project, key or _random.token_hex(32), ctx, mode="redact",
                            detectors=detectors, doc_id=doc_id, text=text)[0]
    col = F.col(text)
    links = F.filter(F.transform(raw_spans(col, ctx, ("tracking",)), _unwrapped), lambda t: t.isNotNull())
    if "tracking" not in {d.id for d in registry.selected(detectors, ())}:
        links = F.array().cast("array<string>")
    # the targets stand behind the text, a line each, so one pass detects in both
    both = docs.withColumn("_wrapped", F.array_distinct(links)).withColumn(
        "_targets", F.transform("_wrapped", lambda t: clean_url(t, ctx.tracking_params))).withColumn(
        "_both", F.when(F.size("_targets") > 0, F.concat(col, F.lit("\n"), F.array_join("_targets", "\n"))).otherwise(col))
    return _redact_found(find_spans(both, detectors=detectors, ctx=ctx, text="_both"), ctx, text).drop("_wrapped", "_targets", "_both")


def _redact_found(found: DataFrame, ctx: Context, text: str) -> DataFrame:
    def plain(s: Column) -> Column:
        kept = (s["type"] == "DOMAIN") & domain_allowed(s["text"], ctx)
        return F.when(kept, F.lit(None)).otherwise(redact_text(s, ctx.redact_template))

    def target(t: Column, k: Column) -> Column:
        ahead = F.aggregate(F.slice("_targets", F.lit(1), k), F.length(text) + 1, lambda a, x: a + F.length(x) + 1)

        def within(begin: Column) -> Column:
            inside = F.filter("spans", lambda s: (s["start"] >= begin) & (s["end"] <= begin + F.length(t)) & (s["type"] != "TRACKING"))
            moved = F.transform(inside, lambda s: _with_replacement(s, plain(s)).withField(
                "start", (s["start"] - begin).cast("int")).withField("end", (s["end"] - begin).cast("int")))
            return apply_spans(t, moved)["output"]

        return let(ahead, within)

    clean = F.transform("_targets", target)

    def value(s: Column) -> Column:
        at = F.array_position("_wrapped", _unwrapped(s)).cast("int")
        return F.when(s["type"] == "TRACKING", F.when(_unwrapped(s).isNull(), "").otherwise(F.get("_clean", at - 1))).otherwise(plain(s))

    own = let(F.length(text), lambda n: F.filter("spans", lambda s: s["end"] <= n))
    marked = found.withColumn("_clean", F.when(F.size("_targets") > 0, clean).otherwise(F.array().cast("array<string>"))).withColumn(
        "_s", F.transform(own, lambda s: _with_replacement(s, value(s))))
    return _apply(marked, "_s", text).drop("spans", "_clean")


# ---------------------------------------------------------------- pseudonymise, anonymise
def originals_of(spans: DataFrame, ts: Column | None = None) -> DataFrame:
    """Distinct originals with usage, from one row per span (partial aggregation before the shuffle)."""
    def meta(key: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("meta"), F.lit(key)), F.lit(""))

    rows = spans.select(
        "type", F.col("text").alias("original"), meta("as_type").alias("as_type"), meta("replacement").alias("replacement"),
        meta("kind").alias("kind"), F.coalesce(meta("keep_prefix").try_cast("int"), F.lit(0)).alias("keep_prefix"),
        (ts if ts is not None else F.current_timestamp()).alias("_ts"))
    return rows.groupBy("type", "original").agg(
        F.max("as_type").alias("as_type"), F.max("replacement").alias("replacement"), F.max("kind").alias("kind"),
        F.max("keep_prefix").alias("keep_prefix"), F.count("*").alias("count"), F.min("_ts").alias("first_seen"),
        F.max("_ts").alias("last_seen"))


def skip_known(found: DataFrame, state: State, project: str, doc_id: str = "doc_id") -> DataFrame:
    """Without findings that are surrogates of the project already (never for IP addresses)."""
    mine = state.mappings.where(F.col("project") == project)
    if mine.isEmpty():
        return found
    forms = mine.groupBy(F.lower("surrogate").alias("_key")).agg(F.collect_set("surrogate").alias("_forms"))
    rows = found.select(doc_id, F.posexplode_outer("spans").alias("_i", "_s")).where(F.col("_s").isNotNull())
    rows = lookup(rows.withColumn("_key", F.lower("_s.text")), forms, ["_key"], F.struct(doc_id, "_i"))
    known = ~F.col("_s.type").isin(*IP_TYPES) & (
        F.coalesce(F.array_contains("_forms", F.col("_s.text")), F.lit(False))
        | (F.col("_s.type").isin(*CASE_INSENSITIVE_TYPES) & F.col("_forms").isNotNull()))
    drop = rows.where(known).groupBy(doc_id).agg(F.collect_set("_i").alias("_drop"))
    joined = found.join(drop, doc_id, "left")
    kept = F.filter("spans", lambda s, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i))
    return joined.withColumn("spans", kept).drop("_drop")


def _learned_by_project(docs: DataFrame, state: State, project: str, doc_id: str, text: str, ctx: Context) -> DataFrame:
    """Column ``_learned``: names the project knows, in all texts (dictionary join on the token map)."""
    names = state.token_map.where((F.col("project") == project) & F.col("map").isin("first", "last")).where(
        (F.length("token") >= 3) & ~F.regexp_like("token", F.lit(ctx.generic())))
    terms = names.groupBy("token").agg(F.min("map").alias("kind")).select(
        F.col("token").alias("term"), F.lit(True).alias("ci"), F.create_map(F.lit("kind"), F.col("kind")).alias("payload"))
    found = wd.with_occurrences(docs, terms, "_occ", doc_id, text)

    def alone(o: Column) -> Column:
        before = F.substring(F.col(text), F.greatest(o["start"] - 1, F.lit(1)), F.least(o["start"], F.lit(2)))
        after = F.substring(F.col(text), o["end"] + 1, F.lit(2))
        return ((o["text"] != F.lower(o["text"])) & ~F.regexp_like(before, F.lit(rf"[{tx.LETTER}]-\z"))
                & ~F.regexp_like(after, F.lit(f"^-[{tx.LETTER}]")))

    spans = F.transform(F.filter("_occ", alone), lambda o: finding(
        o["start"], o["text"], "PERSON", "learned-names", 32, o["payload"]))
    return found.withColumn("_learned", spans).drop("_occ")


def pseudonymize(docs: DataFrame, state: State, project: str, key: str, ctx: Context | None = None, scope: str = "document",
                 mode: str = "pseudonymize", detectors=None, doc_id: str = "doc_id", text: str = "text", ts: str | None = None,
                 avoid_context: bool = True, found: DataFrame | None = None) -> tuple[DataFrame, State]:
    """(docs + output, replacements, warnings; the state with the new mappings).

    Detection runs once; its findings (not the texts) are written to the checkpoint folder and
    feed both the assignment and the rewrite. ``doc_id`` has to be unique. ``scope='project'``
    also looks for names the project learned from other texts.
    """
    ctx = ctx or Context()
    key_col = F.lit(key)
    columns = [doc_id, "spans", "warnings"] + ([ts] if ts else [])
    detected = found is None
    if detected:
        source = docs
        if scope == "project":
            source = _learned_by_project(docs, state, project, doc_id, text, ctx)
        found = find_spans(source, detectors=detectors, ctx=ctx, text=text,
                           extra_spans="_learned" if scope == "project" else None)
    found = found.select(*columns).where(F.size("spans") + F.size("warnings") > 0)
    if detected:  # findings are read more than once from here, texts are not carried along
        found = cut(found)
    spans = skip_known(found, state, project, doc_id)
    if not detected or spans is not found:
        spans = cut(spans.select(*columns).where(F.size("spans") + F.size("warnings") > 0))

    # wrapped links are texts of their own; their findings belong to the same assignment
    def text_mode(s: Column) -> Column:
        return _mode_of(s, mode, ctx)

    rows = spans.select(doc_id, *([ts] if ts else []), F.posexplode("spans").alias("i", "s")).select(
        doc_id, *([ts] if ts else []), "i", "s.*", text_mode(F.col("s")).alias("mode"))
    tracked = rows.where("type = 'TRACKING'").select(_unwrapped(F.struct("meta")).alias("t")).where("t is not null").distinct()
    targets = None
    if not tracked.isEmpty():  # a target is shorter than its wrapper, so this comes to an end
        inner = cut(tracked.select(F.col("t").alias(doc_id), F.col("t").alias(text)))
        done, state = pseudonymize(inner, state, project, key, ctx, "document", mode, detectors, doc_id, text,
                                   avoid_context=avoid_context)
        targets = cut(done.select(F.col(text).alias("_target"), F.col("output").alias("_clean")))

    wanted = rows.where((F.col("type") != "TRACKING") & (F.col("mode") == "pseudonymize"))
    blocked = None
    if avoid_context:
        named = spans.where(F.exists("spans", lambda s: s["type"].isin(
            "EMAIL", "DOMAIN", "HOSTNAME", "USERNAME", "PERSON", "ORG", "LOCATION", "IDENTIFIER", "CUSTOM"))).select(doc_id)
        blocked = cut(wd.context_words(docs.join(named, doc_id, "left_semi"), text))
    new_state = assign(originals_of(wanted, F.col(ts) if ts else None), state, project, key_col, ctx, blocked)
    anonymous = rows.where((F.col("type") != "TRACKING") & (F.col("mode") == "anonymize"))
    if any(m == "anonymize" for m in ctx.type_modes.values()) or mode == "anonymize":
        throwaway = _random.token_hex(32)
        anon = assign(originals_of(anonymous), State.empty(docs.sparkSession), project, F.lit(throwaway), ctx, blocked).mappings.select(
            F.lit("anonymize").alias("mode"), "type", F.col("original").alias("text"), "surrogate")
    else:
        anon = None
    table = new_state.mappings.where(F.col("project") == project).select(
        F.lit("pseudonymize").alias("mode"), "type", F.col("original").alias("text"), "surrogate")
    table = table if anon is None else table.unionByName(anon)
    return _rewrite(docs, spans, rows, table, targets, ctx, doc_id, text), new_state


def _rewrite(docs: DataFrame, spans: DataFrame, rows: DataFrame, table: DataFrame, targets: DataFrame | None, ctx: Context,
             doc_id: str, text: str) -> DataFrame:
    """Look up the replacement of every span and write the texts. Hot originals are salted."""
    found = lookup(rows, table, ["mode", "type", "text"], F.struct(doc_id, "i"))
    target = _unwrapped(F.struct("meta"))
    if targets is not None:
        found = lookup(found.withColumn("_target", target), targets, ["_target"], F.struct(doc_id, "i"))
        clean = F.coalesce("_clean", "_target", F.lit(""))
    else:
        clean = F.coalesce(target, F.lit(""))
    value = F.when(F.col("type") == "TRACKING", clean).when(
        F.col("mode") == "redact", redact_text(F.struct("type"), ctx.redact_template)).otherwise(F.col("surrogate"))
    struct = F.struct("start", "end", "type", "text", "detector", "priority", "meta", value.alias("replacement"))
    per_doc = found.groupBy(doc_id).agg(F.array_sort(F.collect_list(struct.dropFields("meta"))).alias("_s"))
    warned = spans.select(doc_id, "warnings")
    out = docs.join(per_doc.join(warned, doc_id, "full_outer"), doc_id, "left")
    none = empty("array<struct<start:int,end:int,type:string,text:string,detector:string,priority:int,replacement:string>>")
    out = out.withColumn("_s", F.coalesce("_s", none)).withColumn("warnings", F.coalesce("warnings", empty("array<string>")))
    return _apply(out, "_s", text)


def anonymize(docs: DataFrame, style: str = "realistic", ctx: Context | None = None, key: str | None = None, state: State | None = None,
              project: str = "anonymous", detectors=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Irreversible replacements. ``realistic``: surrogates under a key that is thrown away.
    ``placeholder``: ``<TYPE_n>`` numbered in order of the first occurrence."""
    ctx = ctx or Context()
    if style == "realistic":
        return pseudonymize(docs, State.empty(docs.sparkSession), project, key or _random.token_hex(32), ctx,
                            detectors=detectors, doc_id=doc_id, text=text)[0]
    return placeholders(docs, state or State.empty(docs.sparkSession), project, key or _random.token_hex(32), ctx,
                        detectors, doc_id, text)[0]


def placeholders(docs: DataFrame, state: State, project: str, key: str, ctx: Context | None = None, detectors=None,
                 doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, State]:
    ctx = ctx or Context()
    spans = cut(find_spans(docs, detectors=detectors, ctx=ctx, text=text).select(doc_id, "spans", "warnings").where(
        F.size("spans") + F.size("warnings") > 0))
    rows = spans.select(doc_id, F.posexplode("spans").alias("i", "s")).select(
        doc_id, "i", "s.*", _mode_of(F.col("s"), "placeholder", ctx).alias("mode"))
    firsts = rows.where("type <> 'TRACKING' and mode = 'placeholder'").groupBy("type", F.col("text").alias("original")).agg(
        F.min(F.struct(F.col(doc_id).alias("doc"), F.col("start"))).alias("first"))
    firsts = cut(firsts)
    new_state = number_placeholders(firsts, state, project, F.lit(key))
    numbered = firsts.withColumn("hash", tx.keyed_hash(F.lit(key), F.col("type"), F.col("original"))).join(
        new_state.placeholders.where(F.col("project") == project).select("type", "hash", "n"), ["type", "hash"])
    mark = ctx.placeholder_template
    value = F.replace(F.replace(F.lit(mark), F.lit("{type}"), F.col("type")), F.lit("{n}"), F.col("n").cast("string"))
    table = numbered.select(F.lit("placeholder").alias("mode"), "type", F.col("original").alias("text"), value.alias("surrogate"))
    for other in sorted({"pseudonymize", "anonymize"} & set(ctx.type_modes.values())):
        lasting = other == "pseudonymize"
        named = assign(originals_of(rows.where(F.col("mode") == other).where("type <> 'TRACKING'")), new_state if lasting else State.empty(docs.sparkSession),
                       project, F.lit(key if lasting else _random.token_hex(32)), ctx, None)
        new_state = named if lasting else new_state
        table = table.unionByName(named.mappings.where(F.col("project") == project).select(
            F.lit(other).alias("mode"), "type", F.col("original").alias("text"), "surrogate"))
    tracked = rows.where("type = 'TRACKING'").select(_unwrapped(F.struct("meta")).alias("t")).where("t is not null").distinct()
    targets = None
    if not tracked.isEmpty():
        done, new_state = placeholders(cut(tracked.select(F.col("t").alias(doc_id), F.col("t").alias(text))), new_state, project, key, ctx,
                                       detectors, doc_id, text)
        targets = cut(done.select(F.col(text).alias("_target"), F.col("output").alias("_clean")))
    return _rewrite(docs, spans, rows, table, targets, ctx, doc_id, text), new_state


# ---------------------------------------------------------------- revert
def revert_terms(state: State, project: str) -> DataFrame:
    """The dictionary of a project: surrogates of entries and of token maps, with what they mean."""
    here = F.col("project") == project
    entries = state.mappings.where(here & ~F.col("type").isin(*IP_TYPES))
    ci = F.col("type").isin(*CASE_INSENSITIVE_TYPES)
    full = entries.groupBy(F.when(ci, F.lower("surrogate")).otherwise(F.col("surrogate")).alias("term"), ci.alias("ci")).agg(
        F.min(F.struct("original", "type")).alias("o"))
    full = full.select("term", "ci", F.create_map(
        F.lit("type"), F.col("o.type"), F.lit("original"), F.col("o.original"), F.lit("map"), F.lit("entry")).alias("payload"))
    rank = F.create_map(*[F.lit(x) for p in (("words", 1), ("users", 2), ("first", 3), ("last", 4)) for x in p])
    typ = F.when(F.col("map") == "words", "WORD").when(F.col("map") == "users", "USERNAME").otherwise("PERSON")
    tokens = state.token_map.where(here).groupBy(F.lower("surrogate").alias("term")).agg(
        F.min(F.struct(rank[F.col("map")].alias("r"), F.col("token"), F.col("map"), typ.alias("type"))).alias("o"))
    tokens = tokens.select("term", F.lit(True).alias("ci"), F.create_map(
        F.lit("type"), F.col("o.type"), F.lit("original"), F.col("o.token"), F.lit("map"), F.col("o.map")).alias("payload"))
    return full.unionByName(tokens)


def _reverted_ips(docs: DataFrame, state: State, project: str, key: str, ctx: Context, doc_id: str, text: str) -> DataFrame:
    """(doc_id, _ips): addresses that are exact surrogates or lie in a known surrogate network.

    Only distinct addresses are looked up and inverted. Networks are found by equality on the
    network of each prefix length that occurs, so the join stays an equi join.
    """
    here = F.col("project") == project
    v4 = F.transform(hits(F.col(text), network.IPV4, guard=F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))),
                     lambda h: F.struct(h["start"], h["text"]))
    v6 = F.transform(
        F.filter(hits(F.col(text), network.IPV6, guard=F.regexp_like(text, F.lit(":[0-9A-Fa-f]{0,4}:"))),
                 lambda h: ~F.contains(h["text"], F.lit("%"))), lambda h: F.struct(h["start"], h["text"]))
    zoned = F.transform(
        F.filter(hits(F.col(text), network.IPV6, guard=F.contains(text, F.lit("%"))), lambda h: F.contains(h["text"], F.lit("%"))),
        lambda h: F.struct(h["start"], F.substring_index(h["text"], "%", 1).alias("text")))
    found = docs.select(doc_id, F.explode_outer(F.concat(v4, v6, zoned)).alias("h")).where("h is not null").select(
        doc_id, "h.start", F.col("h.text").alias("lit"))
    found = cut(found)
    literals = found.select("lit").distinct()
    exact = state.mappings.where(here & F.col("type").isin(*IP_TYPES)).groupBy(F.col("surrogate").alias("lit")).agg(
        F.min("original").alias("_exact"))
    address = F.substring_index("lit", "/", 1)
    rest = literals.join(exact, "lit", "left").withColumn("version", ip.version_of(address)).withColumn(
        "hex", ip.address_hex(address)).where("hex is not null or _exact is not null")
    nets = state.networks.where(here).select("version", F.substring_index("cidr", "/", -1).cast("int").alias("bits"), "lo").distinct()
    sizes = nets.groupBy("version").agg(F.collect_set("bits").alias("sizes"))  # at most 33 + 129 values
    keyed = rest.join(F.broadcast(sizes), "version", "left").select(
        "lit", "version", "_exact", F.explode_outer("sizes").alias("bits")).withColumn(
        "lo", ip.network_bounds(address, F.col("bits"))["lo"])
    inside = keyed.join(nets.withColumn("_in", F.lit(True)), ["version", "bits", "lo"], "left").groupBy("lit").agg(
        F.first("_exact").alias("_exact"), F.max(F.coalesce("_in", F.lit(False))).alias("_in"))
    original = _session_cached(_original_address, F.lit(key), ctx)
    solved = spread(inside, "lit").withColumn("_orig", original).where("_orig is not null and _orig <> lit").select("lit", "_orig")
    spans = lookup(found, solved, ["lit"], F.struct(doc_id, "start"), "inner")
    typ = F.when(F.contains("lit", F.lit(":")), "IPV6").otherwise("IPV4")
    return spans.groupBy(doc_id).agg(F.collect_list(finding(
        F.col("start"), F.col("lit"), typ, "revert", 30, F.create_map(F.lit("rep"), F.col("_orig")))).alias("_ips"))


def _original_address(key: Column, ctx: Context) -> Column:
    """Original of the address or network in column ``lit`` (columns ``_exact``, ``_in``)."""
    def build(v: Column) -> Column:
        def invert(m: Column) -> Column:
            net = F.concat(let(ip.network_bounds(m, v["p"]), lambda b: ip.hex_to_address(b["lo"], ip.version_of(m))), F.lit("/"), v["p"])
            is_net = ip.network_bounds(v["a"], v["p"])["lo"] == ip.address_hex(v["a"])
            out = F.when(v["p"].isNull(), m).when(is_net, net).otherwise(F.concat(m, F.lit("/"), v["p"]))
            return F.when(v["a"] != F.lower(v["a"]), F.upper(out)).otherwise(out)

        return let(ip.unmap_ip(v["a"], key, ctx.keep_special_hosts), invert)

    parts = F.struct(F.substring_index("lit", "/", 1).alias("a"),
                     F.nullif(F.regexp_extract("lit", r"/(\d+)$", 1), F.lit("")).alias("p"))
    return F.coalesce("_exact", F.when(F.col("_in"), let(parts, build)))


def revert_spans(docs: DataFrame, state: State, project: str, key: str, ctx: Context | None = None, doc_id: str = "doc_id",
                 text: str = "text", inline_limit: int = wd.INLINE_TERMS) -> DataFrame:
    """``docs`` plus ``spans``: what can be translated back, longest first, with the original in ``meta``."""
    ctx = ctx or Context()
    found = wd.with_occurrences(docs, revert_terms(state, project), "_occ", doc_id, text, escapes=True, inline_limit=inline_limit)

    def to_finding(o: Column) -> Column:
        entry = o["payload"]["map"] == "entry"
        value = F.when(entry, o["payload"]["original"]).otherwise(tx.transfer_case(o["text"], o["payload"]["original"]))
        return finding(o["start"], o["text"], o["payload"]["type"], "revert", F.when(entry, 20).otherwise(10),
                       F.create_map(F.lit("rep"), value))

    def usable(o: Column) -> Column:
        return ~(o["payload"]["map"].isin("first", "last") & (o["text"] == F.lower(o["text"])))

    ips = _reverted_ips(docs.select(doc_id, text), state, project, key, ctx, doc_id, text)
    joined = found.join(ips, doc_id, "left")
    every = F.concat(F.coalesce("_ips", empty(FINDINGS)).cast(FINDINGS), F.transform(F.filter("_occ", usable), to_finding).cast(FINDINGS))
    return joined.withColumn("_all", every).withColumn("spans", resolve(F.col("_all"), "length")).drop("_all", "_occ", "_ips")


def revert(docs: DataFrame, state: State, project: str, key: str, ctx: Context | None = None, doc_id: str = "doc_id",
           text: str = "text", inline_limit: int = wd.INLINE_TERMS) -> DataFrame:
    """``docs`` plus ``output`` and ``replacements`` (original = the surrogate, replacement = the restored value)."""
    found = revert_spans(docs, state, project, key, ctx, doc_id, text, inline_limit)
    marked = found.withColumn("_s", F.transform("spans", lambda s: _with_replacement(s, s["meta"]["rep"])))
    return _apply(marked, "_s", text).drop("spans")


def hint(docs: DataFrame, state: State, project: str, key: str, ctx: Context | None = None, doc_id: str = "doc_id",
         text: str = "text", spans: str | None = None) -> DataFrame:
    """``docs`` plus ``looks_pseudonymised`` and ``real_findings``.

    Strong signs are surrogates of four and more characters, or two surrogates of IP addresses;
    they have to be at least as many as the findings that are none.
    """
    ctx = ctx or Context()
    here = F.col("project") == project
    base = docs if spans else skip_known(find_spans(docs, ctx=ctx, text=text), state, project, doc_id).withColumnRenamed("spans", "_f")
    found = base.withColumnRenamed(spans, "_f") if spans else base
    back = revert_spans(found, state, project, key, ctx, doc_id, text)
    back = back.withColumn("_real", outside(F.col("_f"), F.col("spans")))
    known = state.mappings.where(here).select(F.lower("surrogate").alias("_low"), "surrogate").groupBy("_low").agg(
        F.collect_set("surrogate").alias("_forms"))
    seen = back.select(doc_id, F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["type"], s["text"])))).alias("s")).select(
        doc_id, "s.*", F.lower("s.text").alias("_low"))
    joined = lookup(seen, known, ["_low"], F.struct(doc_id, "text"))
    exact = F.coalesce(F.array_contains("_forms", F.col("text")), F.lit(False))
    is_ip = F.col("type").isin(*IP_TYPES)
    votes = joined.groupBy(doc_id).agg(
        F.count_if(~is_ip & (F.length("text") >= 4) & F.col("_forms").isNotNull()).alias("_strong"),
        F.count_if(is_ip & exact).alias("_ip"))
    out = back.join(votes, doc_id, "left")
    strong, strong_ip = F.coalesce("_strong", F.lit(0)), F.coalesce("_ip", F.lit(0))
    real = F.size(F.array_distinct(F.transform("_real", lambda s: F.struct(s["type"], F.lower(s["text"])))))
    looks = ((strong >= 1) | (strong_ip >= 2)) & (strong + strong_ip >= real)
    return out.withColumn("looks_pseudonymised", looks).withColumn(
        "real_findings", F.when(F.size("spans") > 0, F.col("_real")).otherwise(F.col("_f"))).drop(
        "_strong", "_ip", "_real", "_f", "spans")


# ---------------------------------------------------------------- checks and terms
def check_claims(docs: DataFrame, claims: DataFrame, safe: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Claims of an external checker (doc_id, claim[, type]) that really stand in the text and are no
    safe value."""
    good = claims.join(docs.select(doc_id, text), doc_id).where(
        (F.trim("claim") != "") & F.contains(F.col(text), F.col("claim"))).drop(text)
    if safe is not None:
        good = good.join(safe.select(F.col("value").alias("claim")).distinct(), "claim", "left_anti")
    return good


def add_terms(terms: DataFrame, leftovers: DataFrame) -> DataFrame:
    """Leftover values become literal terms, each once."""
    new = leftovers.select(F.col("original").alias("term")).distinct().join(
        terms.select("term"), "term", "left_anti")
    return terms.unionByName(new.select(
        "term", F.lit("").alias("type"), F.lit("").alias("replacement"), F.lit(False).alias("regex"),
        F.lit(False).alias("case_sensitive")), allowMissingColumns=True)
