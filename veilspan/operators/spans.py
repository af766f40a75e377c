"""Span algebra inside a row: choose, apply, blank, subtract, shift, highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.regex import BLOCK, empty, let
from veilspan.schema import REPLACEMENTS

# Blocks of spans whose stretch of text is cut out of the text in one go.
WIDE = 32
_KEY = "struct<s:int,e:int,a:int,b:int,i:int>"


def _sort_keys(spans: Column, by_length: bool) -> Column:
    """(start, end, two preference keys, position): sorts natively, without a comparator."""
    def key(x: Column, i: Column) -> Column:
        prio, length = -x["priority"], x["start"] - x["end"]
        first, second = (length, prio) if by_length else (prio, length)
        return F.struct(x["start"].alias("s"), x["end"].alias("e"), first.cast("int").alias("a"),
                        second.cast("int").alias("b"), i.cast("int").alias("i"))

    return F.filter(F.transform(spans, key), lambda k: k["e"] > k["s"])


def _clusters(keys: Column) -> Column:
    """Group spans that are connected by overlaps; a choice in one group never touches another. A
    group begins where a span starts behind the ends of all before it; the largest end so far comes
    from the blocks before and the own block."""
    def build(v: Column) -> Column:
        ends, n = F.transform(v, lambda k: k["e"]), F.size(v)
        numbers = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

        def group(m: Column) -> Column:
            def first(x: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                own = F.array_max(F.slice(m["ends"], b * BLOCK + 1, i - b * BLOCK))
                reach = F.greatest(own, m["reach"][b])
                return reach.isNull() | (x["s"] >= reach)

            index = F.transform(F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), first(x, i).alias("new"))),
                                         lambda t: t["new"]), lambda t: t["i"])
            return let(index, lambda at: F.transform(at, lambda i, k: F.slice(
                v, i + 1, F.coalesce(F.get(at, k + 1), n) - i)))

        def reached(e: Column) -> Column:
            tops = F.transform(numbers, lambda b: F.array_max(F.slice(e, b * BLOCK + 1, F.lit(BLOCK))))
            return F.struct(e.alias("ends"), let(tops, lambda t: F.transform(
                numbers, lambda b: F.array_max(F.slice(t, F.lit(1), b)))).alias("reach"))

        return let(let(ends, reached), group)

    return let(F.array_sort(keys), lambda v: F.when(F.size(v) > 0, build(v)).otherwise(empty(f"array<array<{_KEY}>>")))


def _greedy(cluster: Column) -> Column:
    ordered = F.array_sort(F.transform(cluster, lambda k: F.struct(k["a"], k["b"], k["s"], k["i"], k["e"])))

    def take(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda t: (t["s"] < x["e"]) & (x["s"] < t["e"]))
        item = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["a"].alias("a"), x["b"].alias("b"), x["i"].alias("i"))
        return F.when(clash, acc).otherwise(F.array_append(acc, item))

    return F.when(F.size(cluster) < 2, cluster).otherwise(
        F.aggregate(ordered, empty(f"array<{_KEY}>"), take))


def resolve(spans: Column, order: str = "priority") -> Column:
    """Largest set of disjoint spans, greedily: by priority, then length, then start (or by length
    first, for ``order='length'``); spans that tie keep the order they came in."""
    def pick(v: Column) -> Column:
        chosen = F.flatten(F.transform(_clusters(_sort_keys(v, order == "length")), _greedy))
        return F.transform(F.array_sort(chosen), lambda k: v[k["i"]])

    return let(spans, lambda v: F.when(F.size(v) < 2, F.filter(v, lambda x: x["end"] > x["start"])).otherwise(pick(v)))


def apply_spans(text: Column, spans: Column, replacement: str = "replacement") -> Column:
    """STRUCT<output, replacements> for disjoint spans sorted by start. Every span has the
    replacement text in the field ``replacement``; NULL or equal to the original means no change."""
    def build(v: Column) -> Column:
        n = F.size(v)
        numbers = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

        def begin_of(b: Column) -> Column:
            return F.when(b == 0, 0).otherwise(v[F.greatest(b * BLOCK - 1, F.lit(0))]["end"])

        def last_of(b: Column) -> Column:
            return v[F.least((b + 1) * BLOCK, n) - 1]["end"]

        def stretch(w: Column) -> Column:
            first, last = w * WIDE, F.least((w + 1) * WIDE * BLOCK, n) - 1
            return F.struct(begin_of(first).alias("begin"), F.substring(text, begin_of(first) + 1, v[last]["end"] - begin_of(first)).alias("t"))

        def block(b: Column, cuts: Column) -> Column:
            """The text from the last span of the block before to the end of the own last one is cut out of
            its stretch, which was cut out of the text; positions inside it are short walks."""
            begin, wide = begin_of(b), cuts[F.floor(b / WIDE).cast("int")]
            head = F.struct(begin.alias("begin"), F.substring(
                wide["t"], begin - wide["begin"] + 1, last_of(b) - begin).alias("t"))

            def run(h: Column) -> Column:
                def step(acc: Column, x: Column) -> Column:
                    chunk = F.substring(h["t"], acc["pos"] - h["begin"] + 1, x["start"] - acc["pos"])
                    out_start = (acc["out"] + F.length(chunk)).cast("int")
                    out_end = (out_start + F.length(x[replacement])).cast("int")
                    rep = F.struct(
                        x["start"].alias("in_start"), x["end"].alias("in_end"), out_start.alias("out_start"),
                        out_end.alias("out_end"), x["type"].alias("type"), x["text"].alias("original"),
                        x[replacement].alias("replacement"), x["detector"].alias("detector"))
                    return F.struct(
                        x["end"].alias("pos"), out_end.alias("out"),
                        F.concat(acc["parts"], F.array(chunk, x[replacement])).alias("parts"),
                        F.array_append(acc["reps"], rep).alias("reps"))

                zero = F.struct(h["begin"].alias("pos"), F.lit(0).alias("out"), empty("array<string>").alias("parts"),
                                empty(REPLACEMENTS).alias("reps"))
                return F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, step, lambda a: F.struct(
                    F.array_join(a["parts"], "").alias("text"), a["out"].alias("size"), a["reps"].alias("reps")))

            return let(head, run)

        def finish(done: Column) -> Column:
            def shifted(d: Column, b: Column) -> Column:
                shift = F.aggregate(F.slice(done, F.lit(1), b), F.lit(0), lambda a, x: a + x["size"])
                return let(shift, lambda s: F.transform(d["reps"], lambda r: F.struct(
                    r["in_start"].alias("in_start"), r["in_end"].alias("in_end"), (r["out_start"] + s).cast("int").alias("out_start"),
                    (r["out_end"] + s).cast("int").alias("out_end"), r["type"].alias("type"), r["original"].alias("original"),
                    r["replacement"].alias("replacement"), r["detector"].alias("detector"))))

            tail = F.substring(text, v[n - 1]["end"] + 1, F.length(text))
            return F.struct(F.concat(F.array_join(F.transform(done, lambda d: d["text"]), ""), tail).alias("output"),
                            F.flatten(F.transform(done, shifted)).alias("replacements"))

        stretches = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / (BLOCK * WIDE)).cast("int")), stretch)
        return let(let(stretches, lambda cuts: F.transform(numbers, lambda b: block(b, cuts))), finish)

    changed = F.filter(spans, lambda x: x[replacement].isNotNull() & (x[replacement] != x["text"]))
    unchanged = F.struct(text.alias("output"), empty(REPLACEMENTS).alias("replacements"))
    return let(changed, lambda v: F.when(F.size(v) > 0, build(v)).otherwise(unchanged))


def blank(text: Column, spans: Column, start: str = "start", end: str = "end") -> Column:
    """Cover spans with bullets, keep the layout; a span that starts inside a covered one is left out."""
    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["pos"]
        covered = F.array(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.repeat(F.lit("•"), x["e"] - x["s"]))
        return F.when(inside, acc).otherwise(F.struct(
            x["e"].alias("pos"), F.concat(acc["parts"], covered).alias("parts")))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x[start].cast("int").alias("s"),
                                                                 x[end].cast("int").alias("e"))))
    zero = F.struct(F.lit(0).alias("pos"), empty("array<string>").alias("parts"))
    return F.aggregate(ordered, zero, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(text, a["pos"] + 1, F.length(text))))


def outside(spans: Column, others: Column, start: str = "start", end: str = "end") -> Column:
    """The spans that overlap none of ``others``."""
    return F.filter(spans, lambda x: ~F.exists(others, lambda o: (x["start"] < o[end]) & (o[start] < x["end"])))


def shift(spans: Column, offset: Column) -> Column:
    """Spans of a chunk at their place in the whole text."""
    return F.transform(spans, lambda x: x.withField("start", (x["start"] + offset).cast("int")).withField(
        "end", (x["end"] + offset).cast("int")))


def page_chunks(pages: Column, limit: int = 400_000) -> Column:
    """ARRAY<STRUCT<start, text>>: pages packed into chunks of at most ``limit`` characters; a page
    that is longer is cut. Offsets refer to the pages written one after the other."""
    chunk = "struct<start:int,text:string>"

    def add(acc: Column, page: Column) -> Column:
        fits = F.length(acc["text"]) + F.length(page) <= limit
        flushed = F.when(F.length(acc["text"]) > 0, F.array_append(
            acc["out"], F.struct(acc["start"], acc["text"]))).otherwise(acc["out"])
        at = (acc["start"] + F.length(acc["text"])).cast("int")
        return F.when(fits, F.struct(acc["start"].alias("start"), F.concat(acc["text"], page).alias("text"),
                                     acc["out"].alias("out"))).otherwise(
            F.struct(at.alias("start"), page.alias("text"), flushed.alias("out")))

    def cut(c: Column) -> Column:
        n = F.greatest(F.ceil(F.length(c["text"]) / limit), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(
            (c["start"] + i * limit).cast("int").alias("start"),
            F.substring(c["text"], (i * limit + 1).cast("int"), F.lit(limit)).alias("text")))

    zero = F.struct(F.lit(0).alias("start"), F.lit("").alias("text"), empty(f"array<{chunk}>").alias("out"))
    packed = F.aggregate(pages, zero, add, lambda a: F.array_append(a["out"], F.struct(a["start"], a["text"])))
    return F.flatten(F.transform(packed, cut))


def highlight(text: Column, spans: Column) -> Column:
    """HTML with the spans marked; everything is escaped."""
    def escape(v: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            v = F.replace(v, F.lit(raw), F.lit(safe))
        return v

    def step(acc: Column, x: Column) -> Column:
        mark = F.concat(F.lit('<span class="hit" title="'), x["type"], F.lit('">'), escape(x["text"]), F.lit("</span>"))
        return F.struct(x["end"].alias("pos"), F.concat(acc["parts"], F.array(
            escape(F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"])), mark)).alias("parts"))

    zero = F.struct(F.lit(0).alias("pos"), empty("array<string>").alias("parts"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), escape(F.substring(text, a["pos"] + 1, F.length(text)))))


def collect_spans(rows: DataFrame, *keys: str, order: str = "priority") -> DataFrame:
    """Aggregate of findings, a row each, per key (a text): the disjoint spans that are chosen among
    them, by start. Findings may come from several tables; a text's findings fit in its row."""
    fields = F.struct("start", "end", "type", "text", "detector", "priority")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("_f")).withColumn(
        "spans", resolve(F.col("_f"), order)).drop("_f")
