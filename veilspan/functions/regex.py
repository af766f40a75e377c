"""Building blocks for regular-expression work inside Catalyst.

Spark returns matches but no offsets. ``hits`` gets offsets from the matches and the gaps
between them: both cover the text completely, so running lengths are the positions. All
lengths are code points. A text without a match costs one ``rlike`` pass and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspan.schema import FINDING, FINDINGS

HIT = "struct<start:int,text:string,before:string,after:string>"
NO_META = "map<string,string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def attempt(value: Column) -> Column:
    """The value, or NULL for a row on which it throws. (Spark has no such function for any expression; this
    is the one inside its ``try_`` functions.)"""
    jvm = SparkSession.active()._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return type(value)(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.TryEval(utils.expression(value._jc))))


def empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def _tail(text: Column, v: Column, i: Column, start: Column, n: int) -> Column:
    """The ``n`` characters in front of match ``i``: from the gap, else with the match and gap before it;
    a walk from the start of the text is the last resort."""
    gap = v["g"][i]
    local = F.concat(F.when(i > 0, F.concat(v["g"][F.greatest(i - 1, F.lit(0))], v["m"][F.greatest(i - 1, F.lit(0))])).otherwise(""), gap)
    far = F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(F.lit(n), start))
    return F.when(F.length(gap) >= n, F.right(gap, F.lit(n))).otherwise(let(local, lambda x: F.when(
        (F.length(x) >= n) | (i < 2), F.right(x, F.lit(n))).otherwise(far)))


def _head(text: Column, v: Column, i: Column, end: Column, n: int) -> Column:
    """The ``n`` characters behind match ``i``, in the same way."""
    gap = v["g"][i + 1]
    local = F.concat(gap, F.coalesce(F.get(v["m"], i + 1), F.lit("")), F.coalesce(F.get(v["g"], i + 2), F.lit("")))
    return F.when(F.length(gap) >= n, F.left(gap, F.lit(n))).otherwise(let(local, lambda x: F.when(
        (F.length(x) >= n) | (i + 2 >= F.size(v["m"])), F.left(x, F.lit(n))).otherwise(F.substring(text, end + 1, F.lit(n)))))


# An array that grows by one element is copied each time, so long ones are built in blocks of this size.
BLOCK = 64


def in_blocks(n: Column, size_of: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """Flattened ``build(indices, before)`` over blocks of 0..n-1 (n > 0); ``before`` is the sum of
    ``size_of(index)`` over all earlier blocks. The work per element does not grow with ``n``."""
    def block(b: Column) -> Column:
        return F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, n) - 1)

    numbers = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    sums = F.transform(numbers, lambda b: F.aggregate(block(b), F.lit(0), lambda a, i: (a + size_of(i)).cast("int")))
    return let(sums, lambda s: F.flatten(F.transform(numbers, lambda b: build(
        block(b), F.aggregate(F.slice(s, 1, b), F.lit(0), lambda a, x: a + x)))))


def _offsets(text: Column, pattern: Column, before: int, after: int) -> Column:
    def build(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            gap, match = v["g"][i], v["m"][i]
            start = (acc["pos"] + F.length(gap)).cast("int")
            end = (start + F.length(match)).cast("int")
            hit = F.struct(
                start.alias("start"),
                match.alias("text"),
                (_tail(text, v, i, start, before) if before else F.lit("")).alias("before"),
                (_head(text, v, i, end, after) if after else F.lit("")).alias("after"),
            )
            return F.struct(end.alias("pos"), F.array_append(acc["out"], hit).alias("out"))

        def of(indices: Column, begin: Column) -> Column:
            zero = F.struct(begin.alias("pos"), empty(f"array<{HIT}>").alias("out"))
            return F.aggregate(indices, zero, step, lambda acc: acc["out"])

        return in_blocks(F.size(v["m"]), lambda i: F.length(v["g"][i]) + F.length(v["m"][i]), of)

    pair = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("g"),
    )
    return let(pair, build)


def hits(
    text: Column,
    pattern: str | Column,
    before: int = 0,
    after: int = 0,
    guard: Column | None = None,
) -> Column:
    """ARRAY<STRUCT<start, text, before, after>> of all matches of ``pattern``.

    The whole match is the hit, so context belongs into look-around or into the ``before`` and
    ``after`` windows. ``guard`` is a cheap test that skips texts which cannot match. Never
    repeat a group without a bound in ``pattern``: Java recurses per repetition.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    test = F.regexp_like(text, p)
    if guard is not None:
        test = guard & test
    return F.when(test, _offsets(text, p, before, after)).otherwise(empty(f"array<{HIT}>"))


def inner(hit: Column, pattern: str, group: int = 1) -> Column:
    """Cut ``group`` of ``pattern`` out of a hit; the pattern has to be anchored at ``^`` and
    everything left of the group has to be in group 1 if ``group`` is 2."""
    part = F.regexp_extract(hit["text"], pattern, group)
    lead = F.length(F.regexp_extract(hit["text"], pattern, 1)) if group > 1 else F.lit(0)
    return F.struct((hit["start"] + lead).cast("int").alias("start"), part.alias("text"))


def finding(
    start: Column,
    text: Column,
    type_: str | Column,
    detector: str,
    priority: int | Column,
    meta: Column | None = None,
) -> Column:
    typ = F.lit(type_) if isinstance(type_, str) else type_
    prio = F.lit(priority) if isinstance(priority, int) else priority
    return F.struct(
        start.cast("int").alias("start"),
        (start + F.length(text)).cast("int").alias("end"),
        typ.alias("type"),
        text.alias("text"),
        F.lit(detector).alias("detector"),
        prio.cast("int").alias("priority"),
        (F.create_map().cast(NO_META) if meta is None else meta).alias("meta"),
    ).cast(FINDING)


def findings(found: Column, type_: str, detector: str, priority: int, keep: Callable | None = None,
             meta: Callable | None = None) -> Column:
    """Turn hits (or anything with ``start`` and ``text``) into findings."""
    kept = F.filter(found, keep) if keep is not None else found
    return F.transform(
        kept,
        lambda h: finding(h["start"], h["text"], type_, detector, priority, meta(h) if meta else None),
    )


def join_findings(*parts: Column) -> Column:
    if len(parts) == 1:
        return parts[0]
    return F.flatten(F.array(*[p.cast(FINDINGS) for p in parts]))


def one_of(value: Column, values) -> Column:
    """Membership in a fixed list of words without commas, held as one string literal: cheap to
    build into a plan. For tests on every row of a large table use ``isin``, which hashes."""
    return F.find_in_set(value, F.lit(",".join(sorted(values)))) > 0


def alternation(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))
