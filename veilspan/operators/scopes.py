"""Names that one text teaches and others use; long texts in slices.

A scope is what shares its names: a text, a document with its title, a project. E-mail addresses of all its
texts teach names (``names.learned_tokens``); each text is then searched for the names of its scope. The
names are a table (scope, token, kind). Words that may be names meet it in a join, broadcast after a check
or salted, so neither a scope with most texts nor one with most names is one task's work.

A text of any length can be cut into slices that many tasks look at: its scope is then the text. Slices
overlap; a finding belongs to the slice in whose own part it begins, and all findings of a text are
chosen among once, where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import text as tx
from veilspan.functions.regex import empty, finding, hits
from veilspan.functions.tables import lookup
from veilspan.lists import Context
from veilspan.operators import detectors as registry
from veilspan.operators.detect import failures, find_spans, keep_findings, raw_spans
from veilspan.operators.detectors.names import NAME_EDGES, learned_tokens
from veilspan.operators.spans import resolve, shift
from veilspan.schema import FINDINGS

LEARNED = "learned-names"
#: Characters of a slice, and by how many slices overlap: more than a finding and what it has around it.
SLICE, OVERLAP = 400_000, 20_000


def taught(texts: DataFrame, scope: str, doc_id: str = "doc_id", text: str = "text", ctx: Context | None = None) -> DataFrame:
    """(scope, token, kind) that the texts of each scope teach; the first kind wins, by id and place."""
    named = texts.select(scope, F.col(doc_id).alias("_o"), F.posexplode_outer(learned_tokens(F.col(text), ctx or Context())).alias("_i", "_t"))
    rows = named.where("_t is not null").select(scope, F.col("_t.token").alias("token"), F.struct("_o", "_i", F.col("_t.kind").alias("kind")).alias("_f"))
    return rows.groupBy(scope, "token").agg(F.min("_f").alias("_f")).select(scope, "token", F.col("_f.kind").alias("kind"))


def _capital_words(text: Column) -> Column:
    """ARRAY<STRUCT<start, text>> of the words that may be a name."""
    found = hits(text, f"{NAME_EDGES[0]}[{tx.LETTER}]{{3,}}{NAME_EDGES[1]}")
    return F.transform(F.filter(found, lambda h: h["text"] != F.lower(h["text"])), lambda h: F.struct(h["start"], h["text"]))


def with_learned(texts: DataFrame, names: DataFrame, scope: str, out: str, keys: list[str], text: str = "text") -> DataFrame:
    """``texts`` plus findings of the names of their scope; ``keys`` tell the rows apart."""
    words = texts.select(scope, *(k for k in keys if k != scope), F.explode_outer(_capital_words(F.col(text))).alias("_w")).where("_w is not null")
    found = lookup(words.withColumn("token", F.lower("_w.text")), names, [scope, "token"], F.struct(*keys, "_w"), "inner")
    spans = finding(F.col("_w.start"), F.col("_w.text"), "PERSON", LEARNED, 32, F.create_map(F.lit("kind"), F.col("kind")))
    per_row = found.select(*keys, F.col("_w.start").alias("_s"), spans.alias("_f")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_s", "_f")), lambda a, b: a["_s"] - b["_s"]).alias("_l"))
    return texts.join(per_row, keys, "left").withColumn(out, F.transform(F.coalesce("_l", F.array().cast(f"array<struct<_s:int,_f:{FINDINGS[6:-1]}>>")),
                                                                       lambda x: x["_f"])).drop("_l")


def find_spans_in_scope(docs: DataFrame, scope: str, detectors=None, skip=(), ctx: Context | None = None, doc_id: str = "doc_id",
                        text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``find_spans`` with the names that any text of a scope teaches; ``known`` are names (scope, token,
    kind) from before. ``doc_id`` has to be unique."""
    ctx = ctx or Context()
    names = taught(docs, scope, doc_id, text, ctx)
    if known is not None:
        names = names.join(known, [scope, "token"], "left_anti").unionByName(known.select(scope, "token", "kind"))
    return find_spans(with_learned(docs, names, scope, "_learned", [doc_id], text), detectors, (*skip, LEARNED), ctx, text, "_learned").drop("_learned")


def slices(docs: DataFrame, size: int = SLICE, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, begin, end, start, cut_left, cut_right, text): the slice's own part is [begin, end) of the
    whole text, its text begins at start and is cut off on a side or not. Own parts end at the last page or line end in their last half, if there is one."""
    piece = "struct<begin:int,end:int>"
    n = F.length(text)

    def add(acc: Column, _k: Column) -> Column:
        window = F.substring(F.col(text), acc["at"] + size // 2 + 1, F.lit(size - size // 2))
        tail = F.length(F.substring_index(window, "\f", -1))
        tail = F.when(tail < F.length(window), tail).otherwise(F.length(F.substring_index(window, "\n", -1)))
        end = F.when(n - acc["at"] <= size, n).otherwise(F.when(tail < F.length(window), acc["at"] + size - tail).otherwise(acc["at"] + size))
        end = end.cast("int")
        return F.when(acc["at"] >= n, acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(
            acc["at"].alias("begin"), end.alias("end"))).alias("out")))

    steps = F.sequence(F.lit(0), F.ceil(n / (size / 2)).cast("int"))
    cuts = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty(f"array<{piece}>").alias("out")), add, lambda a: a["out"])
    cuts = F.when(n <= size, F.array(F.struct(F.lit(0).alias("begin"), n.alias("end")))).otherwise(cuts)
    rows = docs.select(doc_id, text, F.posexplode_outer(cuts).alias("part", "c"))
    start = F.greatest(F.col("c.begin") - overlap, F.lit(0))
    return rows.select(doc_id, "part", F.col("c.begin").alias("begin"), F.col("c.end").alias("end"), start.alias("start"),
                       (start > 0).alias("cut_left"), (F.col("c.end") + overlap < n).alias("cut_right"), F.substring(F.col(text), start + 1, F.col("c.end") + overlap - start).alias(text))


def find_spans_sliced(docs: DataFrame, detectors=None, skip=(), ctx: Context | None = None, size: int = SLICE, overlap: int = OVERLAP,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans, warnings) as ``find_spans`` gives them, from slices dealt out over all tasks.

    A finding longer than ``overlap`` that crosses a cut may be found in part or not at all; the default is
    far above what single values have. ``doc_id`` has to be unique. Texts that are NULL have no spans."""
    ctx = ctx or Context()
    spark = docs.sparkSession
    parts = slices(docs, size, overlap, doc_id, text).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), doc_id, "part")
    learns = LEARNED in {d.id for d in registry.selected(detectors, skip)}
    if learns:  # an address that is cut off would teach a piece of a name; the slice beside has all of it
        left = F.when(F.col("cut_left"), F.regexp_replace(text, r"^\S+", "")).otherwise(F.col(text))
        whole = F.when(F.col("cut_right"), F.regexp_replace(left, r"\S+\z", "")).otherwise(left)
        names = taught(parts.withColumn(text, whole), doc_id, "part", text, ctx)
        parts = with_learned(parts, names, doc_id, "_learned", [doc_id, "part"], text)
    col = F.col(text)
    found = raw_spans(col, ctx, detectors, (*skip, LEARNED))
    found = F.concat(found, F.col("_learned")) if learns else found
    failed = failures(col, ctx, detectors, skip)
    marked = parts.select(doc_id, "begin", "end", shift(found, F.col("start")).alias("_f"), (empty("array<string>") if failed is None else failed).alias("_w"))
    own = F.filter("_f", lambda s: (s["start"] >= F.col("begin")) & (s["start"] < F.col("end")))
    per_doc = marked.select(doc_id, "begin", own.alias("_f"), "_w").groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("begin", "_f", "_w")), lambda a, b: a["begin"] - b["begin"]).alias("_l"))
    every = F.flatten(F.transform("_l", lambda x: F.coalesce(x["_f"], empty(FINDINGS))))
    return per_doc.select(doc_id, resolve(keep_findings(every, ctx)).alias("spans"), F.array_distinct(F.flatten(F.transform("_l", lambda x: x["_w"]))).alias("warnings"))
