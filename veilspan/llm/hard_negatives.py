"""Hard negatives by inner product, found in an R-tree that is packed by sort-tile-recursive.

Rows are points (label, vector of integers). Cuts learned from a bounded sample tile the space: by label
first, then by the coordinate that varies most, into about as many tiles as there are blocks. Every row is
routed by the cuts; a tile with more rows than a block, be it one vector repeated, is dealt to several
blocks by hash. A block is packed in its task: sorted by one coordinate, cut into slabs, each slab sorted
by the next one, down to leaves. Leaves and blocks have the bounds of their rows. The sample decides how
tight these are, never which rows are found.

Per coordinate, a box bounds the product with an anchor between x * low and x * high, so the sums bound
every inner product in it. A search keeps a queue of boxes, best upper bound first, opens blocks into
leaves and scores the rows of a leaf. Boxes are passed over if their labels cannot match, if their bounds
lie outside every score window asked for, or if their upper bound is strictly below the kth score found;
boxes that reach it are opened, as ties go to the smaller id.

Anchors are a stated query set. They go against the whole index in chunks of ``CHUNK`` (the one thing that
is broadcast, with its positives): a pass over the index per chunk and search. Each task returns at most
k rows per anchor or positive; Spark ranks these. Scores are exact: sums in doubles while they are below
2^53, else Python integers, held to 64 bits in the result.

Rows with a null id, label, vector or component take no part. Repeated rows count once. Rows that share an
id but differ are rows each; "other rows" are those of another id. Shorter vectors count as padded with
zeros. An empty table, or one without anchors, gives no rows. Only three columns are read, so names of
others cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import new_folder, stored

BLOCK, LEAF = 512, 32
#: Rows of the sample that the cuts are learned from, and rows of it per tile at least.
SAMPLE, PER_TILE, SEED = 20_000, 8, 41
SLAB_COORDINATES = 4
#: Anchors of one pass, and anchors whose bounds are computed at once.
CHUNK, AT_ONCE = 16_384, 256
EXACT = 2 ** 53
INDEX = ("block bigint, leaf bigint, ids array<bigint>, labels array<bigint>, vectors array<bigint>, leaf_low array<bigint>, leaf_high array<bigint>, "
         "leaf_labels array<bigint>")


def points(df: DataFrame, vec_id: Column, label: Column, vector: Column) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, each once; vector is an ARRAY of integers."""
    rows = df.select(vec_id.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), vector.cast("array<bigint>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                      & ~F.exists("v", lambda x: x.isNull())).distinct()


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``dims``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


class Cuts:
    """Tiles of the space: (coordinate, cut, below, from the cut on) per node; coordinate 0 is the label."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.tiles = 0
        self.root = self._node(sample, tiles)

    def _node(self, rows: np.ndarray, tiles: int) -> int:
        """The number of a node, or -1 - tile."""
        varying = rows.max(0) > rows.min(0) if len(rows) else np.zeros(1, bool)
        if tiles < 2 or not varying.any():
            self.tiles += 1
            return -self.tiles
        axis = 0 if varying[0] else int(np.argmax(rows.astype(float).var(0)))
        values = np.sort(rows[:, axis])
        cut = values[len(values) * (tiles // 2) // tiles]
        if cut == values[0]:
            cut = values[np.searchsorted(values, cut, side="right")]
        below = rows[:, axis] < cut
        share = min(tiles - 1, max(1, round(tiles * below.mean())))
        here = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        self.nodes[here] = (axis, int(cut), self._node(rows[below], share), self._node(rows[~below], tiles - share))
        return here

    def route(self, rows: np.ndarray) -> np.ndarray:
        out, waiting = np.zeros(len(rows), np.int64), [(self.root, np.arange(len(rows)))]
        while waiting:
            node, own = waiting.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                axis, cut, low, high = self.nodes[node]
                below = rows[own, axis] < cut
                waiting += [(low, own[below]), (high, own[~below])]
        return out


def str_order(rows: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """Sort-tile-recursive: places of the rows in order of the leaves they are packed into."""

    def tile(own: np.ndarray, axes: list[int]) -> list[np.ndarray]:
        pages = -(-len(own) // leaf)
        if pages < 2 or not axes:
            return [own]
        slabs = int(np.ceil(pages ** (1 / len(axes))))
        size = leaf * -(-pages // slabs)
        own = own[np.argsort(rows[own, axes[0]], kind="stable")]
        return [part for k in range(0, len(own), size) for part in tile(own[k:k + size], axes[1:])]

    return np.concatenate(tile(np.arange(len(rows)), axes))


def build_index(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The index of points, stored: a row per block. Also the dimensions and the largest magnitude."""
    spark = rows.sparkSession
    n, dims, most = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.greatest(F.array_max("v").cast("decimal(38,0)"), -F.array_min("v").cast("decimal(38,0)"))), F.lit(0))).first()
    sample = rows.sample(min(1.0, SAMPLE / max(n, 1)), SEED).limit(2 * SAMPLE).toArrow()
    cuts = Cuts(np.column_stack([sample.column("label").to_numpy(), matrix(sample.column("v").combine_chunks(), dims)]),
                min(-(-n // BLOCK), max(1, sample.num_rows // PER_TILE)))

    @F.arrow_udf("bigint")
    def tile(label: pa.Array, v: pa.Array) -> pa.Array:
        return pa.array(cuts.route(np.column_stack([label.to_numpy(), matrix(v, dims)])))

    tiled = stored(rows.select("*", tile("label", "v").alias("tile")), "tiles")
    parts = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    block = F.xxhash64("tile", F.pmod(F.xxhash64("vec_id", "v"), "parts"))

    leaf = LEAF

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, v = group.column("vec_id").to_numpy(), group.column("label").to_numpy(), matrix(group.column("v").combine_chunks(), dims)
        rows_ = np.column_stack([labels, v])
        spread = np.where(rows_.max(0) > rows_.min(0), rows_.astype(float).var(0), -1)
        spread[0] = np.inf if spread[0] >= 0 else -1
        axes = [int(k) for k in np.argsort(-spread, kind="stable")[:SLAB_COORDINATES] if spread[k] >= 0]
        by = str_order(rows_, axes, leaf)
        at = np.arange(0, len(by), leaf)
        low, high = np.minimum.reduceat(rows_[by], at), np.maximum.reduceat(rows_[by], at)
        row = {"block": group.column("block")[0].as_py(), "leaf": leaf, "ids": ids[by], "labels": labels[by], "vectors": v[by].ravel(),
               "leaf_low": low[:, 1:].ravel(), "leaf_high": high[:, 1:].ravel(), "leaf_labels": np.column_stack([low[:, 0], high[:, 0]]).ravel()}
        return pa.table({k: pa.array([x], pa.int64() if k in ("block", "leaf") else pa.list_(pa.int64())) for k, x in row.items()})

    packed = tiled.join(F.broadcast(parts), "tile").select("vec_id", "label", "v", block.alias("block")).groupBy("block").applyInArrow(pack, INDEX)
    return stored(packed, "r-tree"), dims, int(most)


class Forest:
    """The blocks of one batch of the index: boxes (blocks first, then their leaves) and rows."""

    def __init__(self, batch: pa.RecordBatch, dims: int, number: type):
        self.blocks = len(batch)
        blocks, leaves, self.children, self.rows = [], [], [], []
        for k in range(len(batch)):
            ids, labels, v, low, high, owned = (batch.column(c)[k].values.to_numpy() for c in ("ids", "labels", "vectors", "leaf_low", "leaf_high", "leaf_labels"))
            v, low, high, owned = v.reshape(-1, dims).astype(number), low.reshape(-1, dims), high.reshape(-1, dims), owned.reshape(-1, 2)
            blocks.append((low.min(0), high.max(0), owned[:, 0].min(), owned[:, 1].max()))
            first = self.blocks + len(leaves)
            leaves += [(low[j], high[j], owned[j, 0], owned[j, 1]) for j in range(len(low))]
            self.children.append(np.arange(first, self.blocks + len(leaves)))
            leaf = batch.column("leaf")[k].as_py()
            self.rows += [(ids[j:j + leaf], labels[j:j + leaf], v[j:j + leaf]) for j in range(0, len(ids), leaf)]
        low, high, *labels = zip(*blocks, *leaves)
        self.low, self.high = np.array(low).astype(number), np.array(high).astype(number)
        self.label_low, self.label_high = (np.array(x) for x in labels)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Best:
    """The k best (score, id) so far; ``least`` is what a score has to reach."""

    def __init__(self, k: int, least: float, most: float):
        self.k, self.least, self.most, self.held = k, least, most, []

    def add(self, score, vec_id: int) -> None:
        if self.least <= score <= self.most:
            if len(self.held) < self.k:
                heapq.heappush(self.held, (score, -vec_id))
            else:
                heapq.heappushpop(self.held, (score, -vec_id))
            if len(self.held) == self.k:
                self.least = self.held[0][0]


def search(forest: Forest, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, wanted: list[list[Best]], same: bool) -> None:
    """Add to ``wanted``, several score windows per anchor, what the forest has: rows of the anchor's
    label but another id (same), or of other labels."""
    for at in range(0, len(anchors), AT_ONCE):
        least, most = forest.bounds(anchors[at:at + AT_ONCE])
        for k in range(len(least)):
            own, windows = labels[at + k], wanted[at + k]
            if not windows:
                continue
            if same:
                usable = (forest.label_low <= own) & (own <= forest.label_high)
            else:
                usable = (forest.label_low != own) | (own != forest.label_high)
            low, high = least[k], most[k]
            top = max(w.most for w in windows)
            queue = [(-min(high[b], top), b) for b in np.flatnonzero(usable[:forest.blocks]).tolist()]
            heapq.heapify(queue)
            floor = min(w.least for w in windows)
            while queue:
                bound, box = heapq.heappop(queue)
                if -bound < floor:
                    break
                if not any(high[box] >= w.least and low[box] <= w.most for w in windows):
                    continue
                if box < forest.blocks:
                    inside = forest.children[box]
                    inside = inside[usable[inside] & (high[inside] >= floor) & (low[inside] <= top)]
                    for leaf, ends in zip(inside.tolist(), high[inside].tolist()):
                        heapq.heappush(queue, (-min(ends, top), leaf))
                    continue
                row_ids, row_labels, rows = forest.rows[box - forest.blocks]
                scores = rows @ anchors[at + k]
                fits = (scores >= floor) & (scores <= top) & ((row_labels == own) & (row_ids != ids[at + k]) if same else row_labels != own)
                for j in np.flatnonzero(fits).tolist():
                    for w in windows:
                        w.add(int(scores[j]), int(row_ids[j]))
                floor = min(w.least for w in windows)


def _matches(index: DataFrame, anchors, dims: int, number: type, windows: list[list[tuple[int, int]]] | None, k: int) -> DataFrame:
    """(anchor, window, vec_id, score, rank): the k best rows of each window of each anchor; without
    windows those of the anchor's label, with any score."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, labels, v), asked = sent.value
        v = v.astype(number)
        same = asked is None
        wanted = [[Best(k, -np.inf, np.inf)] for _ in ids] if same else [[Best(k, *w) for w in each] for each in asked]
        for batch in batches:
            if len(batch):
                search(Forest(batch, dims, number), v, ids, labels, wanted, same)
        found = [(a, w, -i, min(max(s, -2 ** 63), 2 ** 63 - 1)) for a, each in enumerate(wanted) for w, best in enumerate(each) for s, i in best.held]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["anchor", "window", "vec_id", "score"])

    found = index.mapInArrow(run, "anchor bigint, window bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """For each anchor among points and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels with least * positive_score <= 100 * score <= most * positive_score.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    rows = stored(rows, "points")
    index, dims, magnitude = build_index(rows)
    number = np.float64 if magnitude * magnitude * max(dims, 1) < EXACT else object
    anchors = rows.where(is_anchor)
    chunks = -(-anchors.count() // CHUNK)
    anchors = stored(anchors.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(chunks, 1))).alias("chunk")), "anchors")
    out = new_folder(spark, "hard-negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for chunk in range(chunks):
        own = anchors.where(F.col("chunk") == chunk).orderBy("vec_id", "label", "v").toArrow()
        if not own.num_rows:
            continue
        sent = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v").combine_chunks(), dims)
        near: list[list[tuple[int, int]]] = [[] for _ in range(own.num_rows)]
        for r in sorted(_matches(index, sent, dims, number, None, positives).collect(), key=lambda r: (r["anchor"], r["rank"])):
            near[r["anchor"]].append((r["vec_id"], r["score"]))
        windows = [[(-(-least * s // 100), most * s // 100) for _, s in each] for each in near]
        of = spark.createDataFrame([(a, w, int(sent[0][a]), i, s) for a, each in enumerate(near) for w, (i, s) in enumerate(each)],
                                   "anchor bigint, window bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = _matches(index, sent, dims, number, windows, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        found.join(F.broadcast(of), ["anchor", "window"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
