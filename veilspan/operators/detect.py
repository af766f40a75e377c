"""Find sensitive spans in a table of texts: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import ip
from veilspan.functions.regex import attempt, empty, join_findings, let, one_of
from veilspan.lists import Context
from veilspan.operators import detectors as registry
from veilspan.operators.detectors.identity import invalid_terms
from veilspan.operators.spans import resolve
from veilspan.schema import FINDINGS, SECRET_TYPES


def domain_allowed(host: Column, ctx: Context) -> Column:
    """Is the host an allowed domain or below one? Tests the suffixes of the host against a set."""
    labels = F.split(F.lower(host), r"\.")
    return let(labels, lambda p: F.exists(F.sequence(F.lit(1), F.size(p)), lambda i: one_of(
        F.array_join(F.slice(p, i, F.size(p)), "."), {d.lower().strip(".") for d in ctx.allow_domains})))


def ip_allowed(address: Column, ctx: Context) -> Column:
    """Is the address inside an allowed range? Bounds are compared as hex strings of one width."""
    bare = F.substring_index(address, "/", 1)
    test = F.lit(False)
    for cidr in ctx.allow_ip_ranges:
        base, _, bits = str(cidr).partition("/")
        width = int(bits) if bits else (128 if ":" in base else 32)
        bounds = ip.network_bounds(F.lit(base), F.lit(width))
        same = F.contains(bare, F.lit(":")) == F.lit(":" in base)
        test = test | (same & let(F.struct(ip.address_hex(bare).alias("a"), bounds.alias("b")),
                                  lambda v: v["a"].between(v["b"]["lo"], v["b"]["hi"])))
    return F.coalesce(test, F.lit(False))


def keep_findings(spans: Column, ctx: Context) -> Column:
    """Types that are off or kept, blank findings, allowed terms and allowed domains go."""
    dropped = {*ctx.disabled_types, *(t for t, m in ctx.type_modes.items() if m == "keep")}

    def keep(x: Column) -> Column:
        ok = F.regexp_like(x["text"], F.lit(r"(?U)\S"))
        if dropped:
            ok = ok & ~one_of(x["type"], dropped)
        if ctx.allow_terms:
            ok = ok & ~one_of(F.lower(x["text"]), {a.lower() for a in ctx.allow_terms})
        return ok & ((x["type"] != "DOMAIN") | ~domain_allowed(x["text"], ctx))

    return F.filter(spans, keep)


_built: dict[tuple, Column] = {}


def _expression(detector, text: Column, ctx: Context) -> Column:
    """Detector expressions do not depend on the table, so a session builds each of them once."""
    key = (id(SparkSession.active()._jsparkSession), detector, str(text), repr(ctx))
    if key not in _built:
        _built[key] = detector.expr(text, ctx)
    return _built[key]


def _guarded(detector, text: Column, ctx: Context) -> Column | None:
    """Findings of a detector that may fail: NULL for a text on which it throws; None if it cannot even
    be built."""
    try:
        return attempt(_expression(detector, text, ctx))
    except Exception:  # what a user's detector raises is not known beforehand
        return None


def raw_spans(text: Column, ctx: Context, enabled=None, skip=()) -> Column:
    """All findings of the chosen detectors, overlapping, in detector order. A guarded detector that
    fails on a text has none there."""
    parts = []
    for d in registry.selected(enabled, skip):
        part = _guarded(d, text, ctx) if d.guarded else _expression(d, text, ctx)
        if part is not None:
            parts.append(F.coalesce(part, empty(FINDINGS)) if d.guarded else part)
    found = join_findings(*parts) if parts else empty(FINDINGS)
    return found if ctx.max_chars is None else F.when(F.length(text) <= ctx.max_chars, found).otherwise(empty(FINDINGS))


def chosen_spans(text: Column, ctx: Context, enabled=None, skip=()) -> Column:
    """The disjoint spans of a text, by start."""
    return resolve(keep_findings(raw_spans(text, ctx, enabled, skip), ctx))


def failures(text: Column, ctx: Context, enabled=None, skip=()) -> Column | None:
    """ARRAY of a warning per detector that fails on the text, and per term that is no valid pattern; None
    if none can."""
    chosen, warnings = registry.selected(enabled, skip), []
    for d in chosen:
        if d.guarded:
            part = _guarded(d, text, ctx)
            warning = F.lit(f"detector {d.id} failed, skipped")
            warnings.append(warning if part is None else F.when(text.isNotNull() & part.isNull(), warning))
    if any(d.id == "custom" for d in chosen):
        warnings += [F.lit(f"term is no valid pattern, skipped: {term}") for term in invalid_terms(ctx)]
    return F.array_compact(F.array(*warnings)) if warnings else None


def find_spans(docs: DataFrame, detectors=None, skip=(), ctx: Context | None = None, text: str = "text",
               extra_spans: str | None = None) -> DataFrame:
    """``docs`` plus ``spans`` (disjoint, by start) and ``warnings``.

    ``extra_spans`` names a column with findings from elsewhere (entity tables, dictionary
    joins); they take part in the choice between overlapping spans.
    """
    ctx = ctx or Context()
    col = F.col(text)
    found = raw_spans(col, ctx, detectors, skip)
    if extra_spans:
        found = F.concat(found, F.coalesce(F.col(extra_spans), empty(FINDINGS)))
    warning = F.concat(F.lit("text too large ("), F.length(col).cast("string"), F.lit(" chars), skipped"))
    failed = failures(col, ctx, detectors, skip)
    return docs.withColumn("_raw", found).withColumn("spans", resolve(keep_findings(F.col("_raw"), ctx))).withColumn(
        "warnings", F.when(F.length(col) > (ctx.max_chars or 1 << 31), F.array(warning)).otherwise(
            empty("array<string>") if failed is None else failed)).drop("_raw")


def explode_spans(found: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row per span. The outer generator keeps Catalyst from testing ``size(spans) > 0`` below
    it, which would evaluate every detector a second time."""
    return found.select(*keep, F.inline_outer(spans)).where(F.col("start").isNotNull())


def lone_secret(text: Column, spans: Column) -> Column:
    """Is the text one secret and nothing else?"""
    trimmed = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    lead = F.length(F.regexp_extract(text, r"(?U)^\s*", 0))
    only = F.get(spans, F.lit(0))
    return F.coalesce(
        (F.size(spans) == 1) & trimmed.between(1, 4096) & only["type"].isin(*SECRET_TYPES)
        & (only["start"] <= lead) & (only["end"] >= lead + trimmed), F.lit(False))
