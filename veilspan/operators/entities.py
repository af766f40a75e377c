"""Entities found by another system: rows in, findings out, with tests of plausibility."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan import lists
from veilspan.functions import text as tx
from veilspan.functions.regex import empty, finding, hits, let, one_of
from veilspan.schema import FINDINGS
from veilspan.sources.dictionaries import word_forms

ENTITY = "doc_id bigint, start int, `end` int, label string"
PRIORITY = {"ner": 30, "llm": 28}
_WORD = f"[{tx.LETTER}][{tx.LETTER}'’.\\-]*"


def with_types(entities: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for p in lists.ENTITY_LABELS.items() for x in p])
    return entities.withColumn("type", F.try_element_at(labels, F.upper("label"))).where("type is not null")


def located(entities: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Entity rows with their text; offsets outside the text are dropped, the same span counts once."""
    joined = with_types(entities).join(docs.select("doc_id", text), "doc_id").where(
        (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length(text)))
    return joined.withColumn("span", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))).dropDuplicates(
        ["doc_id", "start", "end"])


def occurrences(claims: DataFrame, docs: DataFrame, text: str = "text", detector: str = "llm") -> DataFrame:
    """Rows (doc_id, label, value) without offsets: every whole-word occurrence in that text."""
    named = with_types(claims).groupBy("doc_id").agg(F.collect_set(F.struct("type", "value")).alias("_c"))
    joined = docs.join(named, "doc_id")

    def one(c: Column) -> Column:
        pattern = F.concat(F.lit(tx.LEFT_EDGE), tx.quote_regex(c["value"]), F.lit(tx.RIGHT_EDGE))
        return F.transform(hits(F.col(text), pattern), lambda h: finding(h["start"], h["text"], c["type"], detector, PRIORITY[detector]))

    return joined.select("doc_id", F.flatten(F.transform("_c", one)).cast(FINDINGS).alias("spans"))


def _words(span: Column) -> Column:
    return F.regexp_extract_all(span, F.lit(_WORD), F.lit(0))


def _in_code(text: Column, start: Column, end: Column) -> Column:
    before, after = F.substring(text, F.greatest(start - 1, F.lit(1)), F.least(start, F.lit(2))), F.substring(text, end + 1, F.lit(2))
    left = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    line = F.concat(left, F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1))
    code = r"(?U)\b[A-Za-z_]\w*(?:\.[A-Z_]\w*){2,8}|^\s*at\s+[\w.$<>`]+\(|\w\(\)|::\w"
    return (
        F.regexp_like(before, F.lit(r"(?U)\w\.\z")) | F.regexp_like(after, F.lit(r"^\.\p{Lu}")) | F.regexp_like(after, F.lit(r"^[(\[<]"))
        | F.regexp_like(line, F.lit(code)))


def plausible(entities: DataFrame, common: DataFrame | None = None, english: DataFrame | None = None,
              places: DataFrame | None = None, first_names: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The believable rows of ``located``, PERSON spans cut to their leading name (column ``tokens``:
    ARRAY<STRUCT<s, e, pos, stop>>, optional). Dictionaries are tables with one column ``word``
    (``phrase`` for places); tests against a missing dictionary pass."""
    rows = entities
    if "tokens" not in rows.columns:
        rows = rows.withColumn("tokens", F.lit(None).cast("array<struct<s:int,e:int,pos:string,stop:boolean>>"))
    rows = rows.withColumn("_id", F.struct("doc_id", "start", "end"))
    rows = _with_flags(rows, common, english, places, first_names)
    words = _words(F.col("span"))
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", ""))
    staged = rows.withColumn("_w", words).withColumn("_l", low)
    w, lo, span, typ = F.col("_w"), F.col("_l"), F.col("span"), F.col("type")

    def any_in(values) -> Column:
        return F.exists(lo, lambda x: one_of(x, values))

    legal = any_in(lists.ENTITY_LEGAL_FORMS)
    camel = F.exists(w, lambda x: F.regexp_like(x, F.lit(r"[a-zß-ÿ][A-ZÀ-Þ]|^[A-Z]{2,}[a-z]|\d"))
                     & ~F.regexp_like(x, F.lit(r"^(?:Mc|Mac|De|Di|Da|Du|La|Le|Van|Von|O')[A-ZÀ-Þ][a-zß-ÿ]+$")))
    parts = F.filter(F.flatten(F.transform(lo, lambda x: F.split(x, r"[/.\-]"))), lambda x: x != "")
    public = F.exists(parts, lambda x: one_of(x, lists.PUBLIC_ORGS)) & F.forall(parts, lambda x: one_of(
        x, (*lists.PUBLIC_ORGS, *lists.PUBLIC_ORG_EXTRA, *lists.PUBLIC_ORG_PHRASES, "sas")) | F.regexp_like(x, F.lit(r"^v?[0-9]+(?:\.[0-9]+)*$")))
    base = (
        F.length(F.trim(span)).between(2, 80) & (F.length(span) <= 80) & (F.size(w) > 0)
        & ~F.regexp_like(span, F.lit(r"[=(){}\[\]$;|<>`*#_\\/\":+%~^@\n]"))
        & ~F.forall(lo, lambda x: one_of(x, (*lists.ENTITY_LEGAL_FORMS, "mbh")))
        & ~any_in(lists.ENTITY_CODE_WORDS) & (~camel | legal) & ~_in_code(F.col(text), F.col("start"), F.col("end"))
        & ((typ == "PERSON") | ~public))
    titled = F.forall(w, lambda x: tx.is_title(x))
    person_words = F.size(w).between(2, 4) & titled & ~any_in(lists.ENTITY_STOP_WORDS)
    person_like = ~F.col("_only_common") | F.col("_first_name")
    first = F.get(w, F.lit(0))
    opening = (tx.is_title(first) | ((first == F.upper(first)) & legal)) & ~one_of(F.get(lo, F.lit(0)), lists.ENTITY_STOP_WORDS) & (
        legal | ~F.forall(w, lambda x: x == F.upper(x)))
    org = (
        ~F.regexp_like(span, F.lit("[,;→…|]"))
        & (legal | ~(F.regexp_like(span, F.lit(r"\d|\w\.\w|['’]s\b")) | one_of(F.get(lo, F.lit(0)), lists.MONTHS)
                     | ((F.size(w) == 1) & (F.length(first) <= 3)) | any_in(lists.TECH_WORDS)))
        & (legal | ~F.col("_only_common") | F.col("_names_place")))
    proper = F.col("tokens").isNull() | F.exists("tokens", lambda t: t["pos"] == "PROPN") | legal | (F.col("_names_place") & (F.size(w) >= 2))
    keep = base & F.when(typ == "PERSON", F.when(F.col("tokens").isNull(), person_words & person_like).otherwise(True)).when(
        typ == "LOCATION", opening & F.col("_place")).otherwise(opening & org & proper)
    kept = staged.where(F.coalesce(keep, F.lit(False)))
    run = _name_run(F.col("tokens"), F.col(text))
    cut = kept.withColumn("_run", F.when((typ == "PERSON") & F.col("tokens").isNotNull(), run))
    cut = cut.withColumn("start", F.coalesce(F.get("_run", F.lit(0))["s"], F.col("start"))).withColumn(
        "end", F.coalesce(F.element_at("_run", -1)["e"], F.col("end"))).withColumn(
        "span", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")))
    several = F.size(F.split("span", r"\s+")).between(2, 4) & person_like
    final = cut.where(F.col("_run").isNull() | ((F.size("_run") > 0) & several))
    return final.select(*[c for c in entities.columns])


def _name_run(tokens: Column, text: Column) -> Column:
    """The leading proper nouns in title case (hyphens inside are allowed)."""
    def step(acc: Column, t: Column) -> Column:
        word = F.substring(text, t["s"] + 1, t["e"] - t["s"])
        ok = (t["pos"] == "PROPN") & ~t["stop"] & tx.is_title(word) & ~one_of(F.lower(word), lists.ENTITY_STOP_WORDS)
        dash = (word == "-") & (F.size(acc["run"]) > 0)
        return F.when(acc["done"] | ~(ok | dash), F.struct(acc["run"].alias("run"), F.lit(True).alias("done"))).when(
            dash, acc).otherwise(F.struct(F.array_append(acc["run"], t).alias("run"), F.lit(False).alias("done")))

    zero = F.struct(empty("array<struct<s:int,e:int,pos:string,stop:boolean>>").alias("run"), F.lit(False).alias("done"))
    return F.aggregate(tokens, zero, step, lambda a: a["run"])


def _with_flags(rows: DataFrame, common, english, places, first_names) -> DataFrame:
    """Dictionary tests per entity. Words of all entities are made distinct, joined once per dictionary
    and folded back to one row per entity."""
    defaults = {"_only_common": False, "_first_name": False, "_names_place": False, "_place": places is None}
    if common is None and places is None:
        for name, value in defaults.items():
            rows = rows.withColumn(name, F.lit(value))
        return rows
    parts = F.filter(F.regexp_extract_all(F.col("span"), F.lit(f"[{tx.LETTER}ß]+"), F.lit(0)),
                     lambda p: ~one_of(F.lower(p), lists.SPAN_LINK_WORDS))
    words = rows.select("_id", F.posexplode(parts).alias("_i", "_p")).withColumn("_p", F.lower("_p"))

    def mark(df: DataFrame, table: DataFrame | None, column: str, key: Column, name: str) -> DataFrame:
        if table is None:
            return df.withColumn(name, F.lit(False))
        known = table.select(F.col(column).alias("_k")).distinct().withColumn(name, F.lit(True))
        return df.withColumn("_k", key).join(known, "_k", "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(False)))

    distinct = words.select("_p").distinct()
    if common is not None:
        forms = distinct.withColumn("_f", F.explode(word_forms(F.col("_p"))))
        hit = forms.join(common.select(F.col("word").alias("_f")).distinct(), "_f").select("_p").distinct().withColumn("_c", F.lit(True))
        distinct = distinct.join(hit, "_p", "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    else:
        distinct = distinct.withColumn("_c", F.lit(False))
    distinct = mark(distinct, english, "word", F.col("_p"), "_e")
    distinct = mark(distinct, places, "phrase", F.col("_p"), "_pl")
    distinct = mark(distinct, first_names, "word", tx.fold_accents(F.col("_p")), "_fn")
    per = words.join(distinct, "_p").groupBy("_id").agg(
        F.every("_c").alias("_only_common"), F.max_by(F.lit(True) & F.col("_fn"), -F.col("_i")).alias("_first_name"),
        F.bool_or(F.col("_pl") & ~F.col("_e")).alias("_names_place"), F.every("_pl").alias("_all_places"))
    out = rows.join(per, "_id", "left")
    if places is not None:
        phrase = F.array_join(F.transform(F.regexp_extract_all(F.col("span"), F.lit(f"[{tx.LETTER}ß]+"), F.lit(0)), lambda p: F.lower(p)), " ")
        out = out.withColumn("phrase", phrase).join(places.select("phrase").distinct().withColumn("_ph", F.lit(True)), "phrase", "left").drop("phrase")
        out = out.withColumn("_place", F.coalesce("_ph", F.lit(False)) | F.coalesce("_all_places", F.lit(False))).drop("_ph")
    else:
        out = out.withColumn("_place", F.lit(True))
    for name in ("_only_common", "_first_name", "_names_place"):
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("_all_places")


def entity_findings(entities: DataFrame, detector: str = "ner") -> DataFrame:
    """(doc_id, spans): findings to pass to ``find_spans`` as ``extra_spans``."""
    return entities.groupBy("doc_id").agg(F.collect_list(finding(
        F.col("start"), F.col("span"), F.col("type"), detector, PRIORITY[detector])).cast(FINDINGS).alias("spans"))


def model_entities(docs: DataFrame, load: Callable[[], Callable[[str], list[dict]]], text: str = "text") -> DataFrame:
    """Run a user's model over the texts: loaded once per Python worker, fed with Arrow batches.

    ``load()`` returns a function text -> [{start, end, label}, …].
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(d, int(e["start"]), int(e["end"]), str(e["label"]))
                    for d, t in zip(batch["doc_id"], batch[text], strict=True) for e in model(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "label"])

    return docs.select("doc_id", text).mapInPandas(run, ENTITY)
