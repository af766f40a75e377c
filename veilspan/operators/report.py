"""Counts, leftovers, quality and overview of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import text as tx
from veilspan.functions.tables import lookup
from veilspan.operators import words as wd


def counts_map(replacements: Column) -> Column:
    """MAP<type, count> of one result, without leaving the row."""
    types = F.transform(replacements, lambda r: r["type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(
        t, F.size(F.filter(types, lambda x: x == t)))))


def entity_counts(spans: DataFrame, by=("type",), rollup: bool = False) -> DataFrame:
    """Number of findings per group; ``rollup`` adds the subtotals."""
    grouped = spans.rollup(*by) if rollup else spans.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"))


def category_rollup(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """type -> category -> all, counted per type first so that the join sees a handful of rows."""
    per_type = spans.groupBy("type").agg(F.count("*").alias("c"))
    return per_type.join(F.broadcast(rules), "type").rollup("category", "type").agg(F.sum("c").alias("n"))


def summary(spans: DataFrame) -> DataFrame:
    """Types by number of findings."""
    return spans.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def grouped_findings(spans: DataFrame, *by: str) -> DataFrame:
    """Same value in any case counts once: (by, type, lower-case text) with first form, start and count."""
    return spans.groupBy(*by, "type", F.lower("text").alias("value")).agg(
        F.min_by("text", "start").alias("first_form"), F.min("start").alias("first_start"), F.count("*").alias("n"))


def distinct_replacements(reps: DataFrame) -> DataFrame:
    return reps.groupBy("type", "original", "replacement").agg(F.count("*").alias("n"))


def tracking_apart(reps: DataFrame, *by: str) -> DataFrame:
    return reps.groupBy(*by).agg(
        F.count_if(F.col("type") == "TRACKING").alias("tracking"), F.count_if(F.col("type") != "TRACKING").alias("others"))


def approx_originals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("type").agg(F.approx_count_distinct("text").alias("originals"))


def quality(found: DataFrame, gold: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Precision, recall and F1 per type from exact (doc, type, text) sets."""
    key = [doc_id, "type", "text"]
    a = found.select(*key).distinct().withColumn("_f", F.lit(1))
    b = gold.select(*key).distinct().withColumn("_g", F.lit(1))
    counted = a.join(b, key, "full_outer").groupBy("type").agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"),
        F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def leftovers(result: DataFrame, doc_id: str = "doc_id", output: str = "output") -> DataFrame:
    """(doc_id, original): redacted values of three and more characters that still stand in the output
    of the same text as a whole word (case and spacing ignored). Stays in the row."""
    text = tx.normalise_space(F.col(output))
    originals = F.array_distinct(F.filter(
        F.transform("replacements", lambda r: r["original"]), lambda o: F.length(tx.normalise_space(o)) >= 3))

    def left(o: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?<!\w)"), tx.quote_regex(tx.normalise_space(o)), F.lit(r"(?!\w)"))
        return F.contains(text, tx.normalise_space(o)) & F.regexp_like(text, pattern)

    return result.select(doc_id, F.explode_outer(F.filter(originals, left)).alias("original")).where("original is not null")


def shared_originals(mappings: DataFrame, a: str, b: str) -> DataFrame:
    """Originals two projects have in common."""
    def of(p: str) -> DataFrame:
        return mappings.where(F.col("project") == p).select("type", "original")

    return of(a).intersect(of(b))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a report."""
    return rows.orderBy(*order).limit(n)


def preview(text: Column, n: int = 120) -> Column:
    return F.substring(text, F.lit(1), F.lit(n))


def output_offsets(reps: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Output positions from input positions by running sums (the relational form of ``apply_spans``).
    The window is one text; a text is a row, so it has a bounded number of spans."""
    from pyspark.sql import Window

    grown = F.length("replacement") - F.length("original")
    before = F.coalesce(F.sum(grown).over(Window.partitionBy(doc_id).orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return reps.withColumn("out_start", (F.col("start") + before).cast("int")).withColumn(
        "out_end", (F.col("start") + before + F.length("replacement")).cast("int"))


def occurrences_by_term(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(term, docs, hits): how often the terms of a dictionary occur as whole words."""
    found = wd.with_occurrences(docs, terms, "_occ", doc_id, text, **limits)
    rows = found.select(doc_id, F.explode_outer(F.transform("_occ", lambda o: o["term"])).alias("term")).where("term is not null")
    return rows.groupBy("term", doc_id).agg(F.count("*").alias("n")).groupBy("term").agg(
        F.count("*").alias("docs"), F.sum("n").alias("hits"))


def label_counts(spans: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Findings per label: counted per text before the join, so a text is one row of it."""
    per_doc = spans.groupBy(doc_id, "type").agg(F.count("*").alias("c"))
    return lookup(per_doc, labels, [doc_id], F.col("type"), "inner").groupBy("quality", "toxic", "type").agg(
        F.sum("c").alias("n"), F.count("*").alias("docs"))
