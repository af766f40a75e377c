"""Near-dedup of documents: SimHash fingerprints, searched with vantage-point trees.

A fingerprint has 64 bits: each is set if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Fingerprints are linked if they differ in at most ``bits`` bits; a group is a
connected component.

A tree of vantage points deals the distinct fingerprints out: an inner node has a vantage point v
and a distance t; what lies within t goes one way, what lies beyond the other. By the triangle
inequality, two fingerprints r bits apart have distances to v that differ by r at most. So the r
distances around t go both ways, and each pair meets in a leaf. The tree is fitted on a bounded
sample; every fingerprint goes through it. In its leaf (a task's group) the tree goes on in the same
way until a few fingerprints are left, which are compared. Exact for any sample.

A leaf returns for each fingerprint the smallest one it is linked with inside the leaf, not its
pairs, so a large group of near copies costs rows in proportion. Copies have one fingerprint and
enter once.

Null texts count as empty and have fingerprint 0, which is linked like any other. Null ids are no
component's smallest id, unless there is no other. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import sheltered, stored, text_slices
from veilspan.llm.graph import components

#: Distinct fingerprints that a leaf of the shared tree should hold, of the sample it is fitted on at
#: most, and leaves it has at most (beyond that, leaves hold more and are split further in their task).
LEAF, SAMPLE, LEAVES = 512, 40_000, 16_384
#: Fingerprints that are compared with one another without a further split; rows of a block of that.
COMPARED, BLOCK = 96, 512
SLICE_BYTES = 1 << 20


def fingerprint(text: bytes, words: int) -> int:
    import xxhash

    parts = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[:len(parts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for first in range(0, len(starts), 65_536):
        spans = zip(starts[first:first + 65_536].tolist(), ends[first:first + 65_536].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.int64)[0])


def simhash(words: int = 3):
    """A column function text -> fingerprint."""

    @F.arrow_udf("bigint")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([fingerprint(t, words) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], pa.int64())

    return of


def _distance(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other).astype(np.int64)


def _split(points: np.ndarray, bits: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and the distance with the fewest points in the larger side; None if the
    points cannot be parted well."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        reach = np.cumsum(np.bincount(_distance(points, v), minlength=65))
        for t in range(64 - bits):
            inner, outer = reach[t + bits // 2], len(points) - (reach[t - (bits - bits // 2)] if t >= bits - bits // 2 else 0)
            cost = max(inner, outer)
            if best is None or cost < best[0]:
                best = (cost, v, t)
    return (best[1], best[2]) if best and best[0] <= 0.85 * len(points) else None


def _sides(points: np.ndarray, v: np.uint64, t: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    away = _distance(points, v)
    return away <= t + bits // 2, away > t - (bits - bits // 2)


def grow_tree(sample: np.ndarray, leaf: int, bits: int) -> list[tuple]:
    """Nodes (vantage, distance, inner child, outer child), leaves as (None, number)."""
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        at = len(nodes)
        nodes.append(())
        found = _split(points, bits) if len(points) > leaf else None
        if found is None:
            nodes[at] = (None, leaves)
            leaves += 1
            return at
        inner, outer = _sides(points, *found, bits)
        nodes[at] = (*found, grow(points[inner]), grow(points[outer]))
        return at

    grow(sample)
    return nodes


def _route(nodes: list[tuple], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            todo, leaf, fps = [(0, points)], [], []
            while todo:
                at, held = todo.pop()
                if nodes[at][0] is None:
                    leaf.append(np.full(len(held), nodes[at][1], np.int32))
                    fps.append(held)
                    continue
                v, t, near, far = nodes[at]
                inner, outer = _sides(held, v, t, bits)
                todo += [(child, held[side]) for child, side in ((near, inner), (far, outer)) if side.any()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaf)), pa.array(np.concatenate(fps).view(np.int64))], ["leaf", "fp"])

    return run


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a and b, for all links at once; labels are the smallest index of a class."""
    while True:
        one, two = label[a], label[b]
        low = np.minimum(one, two)
        if (one == two).all():
            return
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label[:] = label[label]


def link(points: np.ndarray, bits: int) -> np.ndarray:
    """For sorted distinct fingerprints: the index of the smallest one in the same class."""
    label = np.arange(len(points))
    todo = [label.copy()]
    while todo:
        held = todo.pop()
        found = _split(points[held], bits) if len(held) > COMPARED else None
        if found is not None:
            todo += [held[side] for side in _sides(points[held], *found, bits)]
            continue
        for first in range(0, len(held), BLOCK):
            rows = held[first:first + BLOCK]
            a, b = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[held[first:]][None, :]) <= bits)
            _unite(label, rows[a], held[first:][b])
    return label


def _link_leaf(bits: int):
    def run(group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy())
        label = link(points.view(np.uint64), bits)
        linked = label != np.arange(len(points))
        return pa.table({"a": pa.array(points[linked], pa.int64()), "b": pa.array(points[label[linked]], pa.int64())})

    return run


def fingerprint_links(prints: DataFrame, bits: int) -> DataFrame:
    """prints (fp, distinct) -> links (a, b) that connect all fingerprints up to ``bits`` bits apart."""
    total = prints.count()
    rate = min(1.0, SAMPLE / max(1, total))
    sample = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(rate * 1_000_000)).select("fp").collect()  # about SAMPLE numbers
    points = np.sort(np.array([r["fp"] for r in sample], np.int64)).view(np.uint64)
    leaf = max(LEAF, total / LEAVES) * len(points) / max(1, total)
    nodes = grow_tree(points, max(2, int(leaf)), bits)
    routed = prints.select("fp").mapInArrow(_route(nodes, bits), "leaf int, fp bigint")
    return routed.groupBy("leaf").applyInArrow(_link_leaf(bits), "a bigint, b bigint")


def near_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the smallest doc_id of its group), root (its smallest fp)."""
    prints = stored(docs.select("doc_id", simhash(words)(F.col("text")).alias("fp")), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(fingerprint_links(least.select("fp"), bits)).select(F.col("node").alias("fp"), "root")
    rooted = stored(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.select("fp", "root").join(groups, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "root")


@sheltered("doc_id", "text")
def near_dedup(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """docs with one row of each group: that of the smallest id."""
    return one_of_each(docs, near_groups(docs, words, bits), simhash(words))


def one_of_each(docs: DataFrame, groups: DataFrame, print_of) -> DataFrame:
    """docs with one row of each root of groups (doc_id, fp, root): that of the smallest id. Ids of one
    row are kept by a semi join; rows whose id is null or repeated are told apart by their fingerprint,
    print_of(text), only if there are any."""
    rows = stored(groups, "near-groups")
    kept = stored(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k")).select(
        F.col("root").alias("_root"), F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp")), "near-kept")
    odd = stored(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_odd")), "near-odd")
    out = docs.join(kept.join(odd, F.col("_id") == F.col("_odd"), "left_anti"), F.col("doc_id") == F.col("_id"), "left_semi")
    if not odd.isEmpty():
        repeated = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi").withColumn("_print", print_of(F.col("text")))
        one = repeated.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp"))).groupBy("_root").agg(
            F.first(F.struct(*docs.columns)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
