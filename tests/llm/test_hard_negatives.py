"""Hard negatives against all inner products, through the registered query and small blocks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import hard_negatives as hard
from veilspan.llm.queries import QUERIES


def brute(rows, is_anchor, positives=5, negatives=3, least=50, most=95):
    """rows: (id, label, integers)."""
    out = []
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, own, v in rows:
        if is_anchor(a):
            scored = sorted((-product(v, w), i, label) for i, label, w in rows)
            for p, i, _ in [s for s in scored if s[2] == own and s[1] != a][:positives]:
                fits = [(-n, j) for n, j, label in scored if label != own and least * -p <= 100 * -n <= most * -p]
                out += [(a, i, k + 1, j, -p, n) for k, (n, j) in enumerate(fits[:negatives])]
    return sorted(out)


def of_table(spark, path):
    rows = []
    for r in spark.read.parquet(f"{path}/embeddings.parquet").collect():
        if r.vec_id is not None and r.label is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(int(np.floor(256 * float(x))) for x in r.embedding)))
    return sorted(set(rows))


def run(spark, path):
    return sorted(map(tuple, QUERIES["op13_str_tree_negatives"][0](spark, str(path)).collect()))


def test_query_on_the_table(spark, sf):
    got = run(spark, sf)
    assert got == brute(of_table(spark, sf), lambda i: i % 50 == 0) and len(got) > 100


@pytest.mark.parametrize("chunk", [16_384, 2])
def test_query_on_odd_rows(spark, tmp_path, monkeypatch, chunk):
    """Nulls, values that are not finite, equal vectors, ties, repeated rows, shorter vectors, a hot label."""
    monkeypatch.setattr(hard, "BLOCK", 40)
    monkeypatch.setattr(hard, "LEAF", 8)
    monkeypatch.setattr(hard, "CHUNK", chunk)
    rng = random.Random(8)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    same = vector()
    rows = [(i, list(same) if i % 3 == 0 else vector(), rng.choice([0, 0, 0, 1, 2, 9])) for i in range(-100, 300)]
    rows += [(1000, None, 1), (1001, vector(), None), (None, vector(), 1), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 6, 0),
             (1150, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0), (1200, [0.5, 0.25], 0), (1250, [], 0), (1300, [0.0] * 6, 0), rows[0], rows[100], rows[100]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for name in ("v", "block", "tile", "anchor", "score"):
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run(spark, tmp_path) == brute(of_table(spark, tmp_path), lambda i: i % 50 == 0)


def test_empty_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("no-anchor", [(1, [0.5], 0), (2, [0.5], 0)]), ("one", [(50, [0.5], 0)])):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert run(spark, f"{tmp_path}/{name}") == []


def test_large_integers_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.randint(-2 ** 30, 2 ** 30) for _ in range(4)]) for i in range(60)]
    points = hard.points(spark.createDataFrame(rows, "vec_id bigint, label int, v array<bigint>"), F.col("vec_id"), F.col("label"), F.col("v"))
    got = hard.hard_negatives(points, F.col("vec_id") % 50 == 0, 5, 3, 50, 95)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0)


def test_boxes_bound_and_queue_prunes():
    """Bounds hold for every row, and boxes that cannot matter are not opened."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-5, 5, (64, 3)) + c for c in ((0, 0, 100), (0, 100, 0), (-100, 0, 0))])
    order = hard.str_order(np.column_stack([np.zeros(len(v), np.int64), v]), [1, 2, 3], hard.LEAF)
    assert sorted(order.tolist()) == list(range(len(v)))
    v = v[order]
    at = np.arange(0, len(v), hard.LEAF)
    low, high = np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)
    row = {"ids": np.arange(len(v)), "labels": np.zeros(len(v), np.int64), "vectors": v.ravel(), "leaf_low": low.ravel(), "leaf_high": high.ravel(),
           "leaf_labels": np.zeros(2 * len(low), np.int64)}
    batch = pa.RecordBatch.from_pydict({"leaf": pa.array([hard.LEAF])} | {k: pa.array([x], pa.list_(pa.int64())) for k, x in row.items()})
    forest = hard.Forest(batch, 3, np.float64)
    anchors = rng.integers(-9, 9, (20, 3)).astype(float)
    least, most = forest.bounds(anchors)
    for leaf in range(len(low)):
        scores = anchors @ v[leaf * hard.LEAF:(leaf + 1) * hard.LEAF].T
        assert (scores.min(1) >= least[:, 1 + leaf]).all() and (scores.max(1) <= most[:, 1 + leaf]).all()
    opened = []
    forest.rows = type("Rows", (list,), {"__getitem__": lambda self, k: opened.append(k) or list.__getitem__(self, k)})(forest.rows)
    best = hard.Best(3, -np.inf, np.inf)
    hard.search(forest, np.array([[0.0, 0.0, 1.0]]), np.array([-1]), np.array([0]), [[best]], True)
    assert sorted(-s for s, _ in best.held) == sorted(-v[:, 2])[:3] and len(opened) <= 2
