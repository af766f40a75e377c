"""The pipeline stage by stage against plain versions, and its registration."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from veilspan.llm.decontaminate import best_match
from veilspan.llm.quality import document_statistics, fit, statistics
from veilspan.llm.queries import GOOD, QUERIES, held_out

from .test_operators import brute_targets
from .test_shingle_dedup import brute_groups

KEPT = re.compile(r"[^\W_]+")


def words(text):
    return [w for w in ("".join(KEPT.findall(x.decode().lower())) for x in text.encode().split()) if w]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stages[name] = docs.collect()
        assert docs.columns[:5] == columns and (k == 4 or docs.columns == columns)
    good, near, clean, mixed, sharded = stages.values()

    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    model = fit(document_statistics(source), labels)
    want = {i for i, r in kept.items() if model.score(np.array([statistics(r.text.encode())], np.float32).astype(float))[0] >= GOOD}
    assert {r.doc_id for r in good} == want and 0 < len(want) < len(kept)

    ids = sorted(want)
    assert {r.doc_id for r in near} == {ids[c] for c in set(brute_groups([kept[i].text for i in ids]))} and len(near) < len(good)

    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in near if any(len(i) >= 8 and best_match(i, words(r.text))[0] <= len(i) // 5 for i in items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near} - leaks and leaks

    size = {r.doc_id: len(r.text.encode().split()) for r in clean}
    sizes, taken, copies = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in mixed)
    for r in clean:
        sizes[r.source] += size[r.doc_id]
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
    targets = brute_targets(sizes)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    assert all(abs(taken[s] - targets[s]) <= max(size[r.doc_id] for r in clean if r.source == s) for s in sizes)
    assert all(r.text == kept[r.doc_id].text for r in mixed)

    key = lambda r: (r.doc_id, r.text)
    assert Counter(map(key, sharded)) == Counter(map(key, mixed)) and {r.shard for r in sharded} <= set(range(40))
    load = defaultdict(int)
    for r in sharded:
        load[r.shard] += len(r.text.encode()) + 16
    assert max(load.values()) <= max(math.ceil(1.05 * sum(load.values()) / 40), 2 * max(len(r.text.encode()) + 16 for r in sharded))


def test_stages_stand_odd_tables(spark, sf, odd, empty):
    rows = odd.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert set(out.columns) >= set(odd.columns) and out.count() <= 2 * rows, name
        assert stage(spark, empty, sf).count() == 0, name


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
