"""Input columns named like columns inside: nothing fails, nothing is changed."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from veilspan.llm.common import free_name
from veilspan.llm.near_dedup import near_dedup

NAMES = ("_id", "_t", "_u", "_copies", "_rows", "_n", "_x", "_k", "_print", "_odd", "_root", "_fp", "_first", "n", "key", "fp", "root", "row", "bands", "held",
         "p", "size", "copies", "rows", "label", "stats", "score", "shard", "virtual_slot", "component_id", "Text_Key", "_carried_0")


def test_stages_and_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in NAMES:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    plain = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in [*pipeline.STAGES, ("simhash", lambda s, d, f: near_dedup(d))]:
        out = stage(spark, docs, sf)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r)[:len(docs.columns)] == plain[r.doc_id] for r in rows), name
        if name == "sharding":
            assert out.columns[len(docs.columns):] == ["virtual_slot_2", "shard_2"] and {r.shard_2 for r in rows} <= set(range(40))


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "shard int, Shard_2 int, other int")
    assert free_name(df, "shard") == "shard_3" and free_name(df, "new") == "new"
