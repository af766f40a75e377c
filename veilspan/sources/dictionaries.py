"""Dictionaries built from a corpus, and tests against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions import text as tx


def word_counts(corpus: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n); counted per partition before the shuffle."""
    token = F.explode_outer(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-zà-ɏß]{2,}"), F.lit(0))).alias("word")
    return corpus.select(F.col(lang).alias("lang"), token).where(F.col("word").isNotNull()).groupBy("lang", "word").agg(F.count("*").alias("n"))


def build_dictionary(corpus: DataFrame, top_n: int = 120_000, lang: str = "lang", text: str = "text", buckets: int = 64) -> DataFrame:
    """(lang, word, n, rank): the most frequent words per language, ties by word.

    A language may hold most words, so the first cut happens per slice of a language: what is
    not among the first ``top_n`` of its slice cannot be among them overall.
    """
    order = (F.desc("n"), F.col("word"))
    counted = word_counts(corpus, lang, text).withColumn("_b", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    local = counted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= top_n)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top_n).select("lang", "word", "n", "rank")


def place_phrase(name: Column) -> Column:
    """Lower case, separators to one space; NULL for odd names."""
    phrase = F.trim(F.regexp_replace(F.lower(name), r"[\s\-/,.'’]+", " "))
    return F.when(F.regexp_like(phrase, F.lit(r"^[a-zà-ɏß]{2,}(?: [a-zà-ɏß]+){0,5}$")), phrase)


def place_dictionary(places: DataFrame, countries: tuple = (), min_population: int = 0) -> DataFrame:
    """Phrases of places (name, alternates ARRAY, country, population) after the filters."""
    kept = places.where(F.col("population") >= min_population)
    if countries:
        kept = kept.where(F.col("country").isin(*countries))
    names = kept.select(F.explode(F.concat(F.array("name"), F.coalesce("alternates", F.array().cast("array<string>")))).alias("n"))
    return names.select(place_phrase(F.col("n")).alias("phrase")).where("phrase is not null").distinct()


def first_name_dictionary(names: DataFrame) -> DataFrame:
    return names.select(tx.fold_accents(F.col("name")).alias("name")).where(
        F.regexp_like("name", F.lit("^[a-z]{2,}$")) & ~F.col("name").isin(*lists.AMBIGUOUS_FIRST_NAMES)).distinct()


def word_forms(word: Column) -> Column:
    """A word and the singular forms it may stand for."""
    w = F.lower(word)

    def without(n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    return F.array_distinct(F.array_compact(F.array(
        w, F.when(F.endswith(w, F.lit("ies")), F.concat(without(3), F.lit("y"))),
        F.when(F.endswith(w, F.lit("es")), without(2)), F.when(F.endswith(w, F.lit("s")), without(1)))))


def common_words(rows: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """``rows`` whose word, or its singular, is in the dictionary (column ``word``)."""
    forms = rows.select(word).distinct().withColumn("_w", F.explode(word_forms(F.col(word))))
    known = forms.join(dictionary.select(F.col("word").alias("_w")).distinct(), "_w", "left_semi").select(word).distinct()
    return rows.join(known, word, "left_semi")
