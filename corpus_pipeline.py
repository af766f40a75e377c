"""A training corpus from documents: judged, deduplicated, decontaminated, mixed and sharded.

Each stage gets what its predecessor kept and returns the columns of documents; the last one adds
virtual_slot and shard. Stages are written as Parquet and read again, so a lost executor costs the
tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import new_folder, table
from veilspan.llm.decontaminate import decontaminate
from veilspan.llm.mixing import mix
from veilspan.llm.quality import good_documents
from veilspan.llm.queries import GOOD, SHARDS, held_out
from veilspan.llm.sharding import shard
from veilspan.llm.shingle_dedup import shingle_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; held-out labels do not teach it."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return good_documents(docs, labels, GOOD)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the smallest id: sets of
    five-word shingles with a Jaccard similarity of 0.8 or more. Candidates come from vantage-point trees
    over SimHashes (as in op5) and from MinHash bands, for what the trees cannot reach."""
    return shingle_dedup(docs, words=5, similar=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item, up to a fifth of its words edited, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; documents taken twice are there twice."""
    return mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, SHARDS)[0]


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: A trained classifier and random rounding are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
