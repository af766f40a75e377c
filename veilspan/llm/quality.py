"""Quality classifier: kernel ridge regression on document statistics, with isotonic calibration.

A document is described by statistics of its whole text. Random Fourier features approximate a
Gaussian kernel over the standardised statistics; ridge regression on them is solved from the normal
equations, which are sums over documents: each partition sums its own, and the sums are added in a
tree. The sums are kept by fold, so each fold gets raw scores from weights that have not seen it. These
are counted on a fixed grid and made monotone (pool adjacent violators): a score is the share of good
documents among those alike.

All labelled documents are used; nothing is sampled. Only the texts are inputs of a score.

Null texts count as empty; an empty text has the statistics of one and gets a score like any other.
Rows without a label or id do not teach. Several labels of an id: the largest counts. Without any
label every score is 0.5; with one class only, it is near that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored, text_slices

#: Random features, width of the kernel (in standard deviations, per square root of a statistic), ridge.
FEATURES, WIDTH, RIDGE, SEED = 256, 1.5, 0.1, 97
FOLDS = 4
#: Statistics are held to this many standard deviations; raw scores to the grid.
REACH, GRID_LOW, GRID_HIGH, GRID_STEPS = 6.0, -0.5, 1.5, 2000
FAN_IN = 8
SLICE_BYTES = 1 << 20

_CLASSES = np.zeros((256, 9))
for _k, _bytes in enumerate((
    range(65, 91), range(97, 123), range(48, 58), (32, 9, 13, 11, 12), (10,), b".,;:'\"?()-", b"!", b"|", range(128, 256),
)):
    _CLASSES[list(_bytes), _k] = 1.0
STATISTICS = 9 + 1 + 9


def statistics(text: bytes) -> list[float]:
    """Shares of character classes, entropy, lengths of words and lines, repetition."""
    size = len(text) or 1
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _CLASSES / size
    seen = counts[counts > 0] / size
    words, lines = text.split(), text.split(b"\n")
    n = len(words) or 1
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        *shares.tolist(), 1.0 - float(shares.sum()), float(-(seen * np.log2(seen)).sum()),
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(np.log1p(lengths.std())), float(np.log1p(lengths.max())),
        np.log1p(len(set(words))) / np.log1p(n), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]


def text_statistics() -> Column:
    """Statistics of the column ``text``."""

    @F.arrow_udf("array<float>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([statistics(t) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], pa.list_(pa.float32()))

    return of(F.col("text"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), STATISTICS)


@dataclass(frozen=True)
class Model:
    """What a score needs: scale of the statistics, ridge weights, calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray
    taught: bool = True

    def fourier(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(SEED))
        w = rng.normal(0, 1 / (WIDTH * np.sqrt(STATISTICS)), (STATISTICS, FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -REACH, REACH)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.weights, GRID_LOW, GRID_HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def add_up(sums: DataFrame) -> np.ndarray | None:
    """Add vectors (part, data: doubles as bytes) in a tree, in order of part; None if there are none."""

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        total = np.sum([np.frombuffer(d, np.float64) for d in group.column("data").to_pylist()], axis=0)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "data": pa.array([total.tobytes()])})

    sums = stored(sums, "partial-sums")
    most = sums.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most >= FAN_IN:
        sums = stored(sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("up")).applyInArrow(add, "part bigint, data binary"), "partial-sums")
        most //= FAN_IN
    return np.sum([np.frombuffer(r["data"], np.float64) for r in sums.orderBy("part").collect()], axis=0)


def _sums(of_batch):
    """One vector per partition: the sum of of_batch(statistics, labels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            if len(batch):
                part = batch.column("part")[0].as_py()
                found = of_batch(_matrix(batch.column("stats")), batch.column("label").to_numpy().astype(np.float64), batch.column("fold").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()])], ["part", "data"])

    return run


def pool(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (places, values) for interpolation; pools adjacent violators."""
    blocks: list[list[float]] = []
    for x, g, n in zip(at, good, count):
        blocks.append([x * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats), stored: the texts are read once."""
    return stored(docs.select("doc_id", text_statistics().alias("stats")), "statistics")


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """From document_statistics and labels (doc_id, label 0 or 1). One row of sums per partition, the
    sums in a tree, and one row per step of the grid come to the driver."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    taught = stored(stats.join(known, "doc_id").select(
        "stats", "label", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")), "taught")
    taught = taught.withColumn("part", F.spark_partition_id().cast("bigint"))

    def total(of_batch) -> np.ndarray | None:
        return add_up(taught.mapInArrow(_sums(of_batch), "part bigint, data binary"))

    s = total(lambda x, y, fold: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    nothing = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]), False)
    if s is None:
        return nothing
    mean = s[1:STATISTICS + 1] / s[0]
    scale = np.sqrt(np.maximum(s[STATISTICS + 1:] / s[0] - mean ** 2, 0)) + 1e-6
    scaled = Model(mean, scale, nothing.weights, nothing.at, nothing.value)

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = scaled.fourier(x)
        return np.concatenate([v for k in range(FOLDS) for own in (fold == k,) for v in ((z[own].T @ z[own]).ravel(), z[own].T @ y[own])])

    n = FEATURES + 1
    ridge = np.diag([RIDGE] * FEATURES + [1e-6])
    sums = total(normal).reshape(FOLDS, n * n + n)

    def solve(v: np.ndarray) -> np.ndarray:
        return np.linalg.solve(v[:n * n].reshape(n, n) + ridge, v[n * n:])

    unseen = np.array([solve(sums.sum(0) - fold) for fold in sums])
    step = (GRID_HIGH - GRID_LOW) / GRID_STEPS

    def raw_unseen(x: pa.Array, fold: pa.Array) -> pa.Array:
        return pa.array(np.clip((scaled.fourier(_matrix(x)) * unseen[fold.to_numpy()]).sum(1), GRID_LOW, GRID_HIGH))

    grid = taught.select("label", F.arrow_udf(raw_unseen, "double")("stats", "fold").alias("raw")).groupBy(
        F.floor((F.col("raw") - GRID_LOW) / step).alias("bin")).agg(
        F.avg("raw").alias("at"), F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at, value = pool(*(np.array([float(r[c]) for r in grid]) for c in ("at", "good", "n")))
    return Model(mean, scale, solve(sums.sum(0)), at, value)


def scores(model: Model) -> Column:
    """Scores of the column ``stats``, on executors."""
    return F.arrow_udf(lambda x: pa.array(model.score(_matrix(x))), "double")(F.col("stats"))


def text_scores(model: Model) -> Column:
    """Scores of the column ``text``: a filter by it does not shuffle the texts."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            x = np.array([statistics(t) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], np.float32)
            yield pa.array(model.score(x.astype(np.float64).reshape(-1, STATISTICS)))

    return score(F.col("text"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """docs with a score of ``least`` or more. Without any label nothing is known and all stay."""
    model = fit(document_statistics(docs), labels)
    return docs.where(text_scores(model) >= least) if model.taught else docs
