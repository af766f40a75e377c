"""The queries of this subpackage, one per operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import BLANKS, table
from veilspan.llm.decontaminate import contaminated
from veilspan.llm.exact_dedup import exact_dedup
from veilspan.llm.hard_negatives import hard_negatives, points
from veilspan.llm.line_dedup import line_dedup
from veilspan.llm.mixing import copies_per_row, plan_copies
from veilspan.llm.near_dedup import near_groups
from veilspan.llm.periodic_runs import longest_run, periodic_runs
from veilspan.llm.quality import document_statistics, fit, scores
from veilspan.llm.sharding import positions
from veilspan.llm.substring_dedup import substring_dedup
from veilspan.llm.token_counts import count_tokens
from veilspan.llm.token_files import token_ids
from veilspan.llm.toxicity import toxicity

SHARDS = 40
END_ID = 1
CONTEXT_TOKENS = 4096
GOOD = 0.7
TOXIC = 0.5


def held_out() -> Column:
    """Rows whose labels are kept away from training: their score can be measured."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer lies; jobs of one's own pass a path to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)


def op2_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = document_statistics(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return stats.select("doc_id", held_out().alias("held_out"), scores(fit(stats, labels)).alias("score")).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int"))


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"), exact=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("bigint").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_copies(table(spark, sf_dir, "documents"))
    return copies_per_row(plan).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, bits=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = positions(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > CONTEXT_TOKENS).alias("over_limit"))


def op8_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op10_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_away = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~kept_away).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity(table(spark, sf_dir, "documents"), labels, {"doc_id": F.col("doc_id"), "held_out": kept_away})
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def planted_period(doc_id: Column, text: Column) -> Column:
    """The text, but of every tenth checksum of doc_id with a tail that repeats, as its checksum says."""
    check = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, BLANKS), "")
    n, g = F.size(words), F.floor(check / 10)
    a = g % n
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), period), F.ceil((n - a) / period).cast("int")))
    changed = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((check % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def op12_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    top = longest_run(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return periodic_runs(docs).withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_str_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.floor(256 * x.cast("double"))))
    rows = points(table(spark, sf_dir, "embeddings"), F.col("vec_id"), moved, finite)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, least=50, most=95)


OP10_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256 from d join g using (text_sha256)"""

QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_fourier_quality": (op2_fourier_quality, None),
    "op3_fuzzy_lines": (op3_fuzzy_lines, None),
    "op4_pivotal_mix": (op4_pivotal_mix, None),
    "op5_simhash_vptree": (op5_simhash_vptree, None),
    "op6_virtual_slots": (op6_virtual_slots, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_edit_decontamination": (op8_edit_decontamination, None),
    "op9_super_kmers": (op9_super_kmers, None),
    "op10_cuckoo_dedup": (op10_cuckoo_dedup, OP10_SQL),
    "op11_boosted_toxicity": (op11_boosted_toxicity, None),
    "op12_recompression_runs": (op12_recompression_runs, None),
    "op13_str_tree_negatives": (op13_str_tree_negatives, None),
}
