"""Near-dedup of documents by the Jaccard similarity of their word shingles: vantage-point trees over
SimHashes and MinHash bands, exact check.

Shingles are ``words`` consecutive words (lower case for A-Z, cut at ASCII white space) as 64-bit
codes; a shorter text is one shingle. Two documents are linked if their sets of shingles have a
similarity of ``similar`` or more; a group is a connected component.

Candidates come from two searches. The SimHashes of the sets go through the trees of ``near_dedup``,
which find every pair up to two bits apart. SimHashes of two documents of similarity 0.8 differ in about
10 of 64 bits, too far for any tree over fingerprints that are almost random. So MinHash finds the
others: 40 bands of five minima, of which one is equal with a chance of 1 - (1 - s^5)^40. At s = 0.8 one pair in eight million is not
found, above it fewer. Documents of a shared band are hung under one of them, not paired. The
candidates that hang together are compared by their whole sets, so every link is exact; a crowded
cluster is cut into tiles, every pair of tiles being a task's group.

Copies have one set and enter once. Null texts count as empty; empty texts are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import sheltered, stored, text_slices
from veilspan.llm.graph import components
from veilspan.llm.near_dedup import fingerprint_links, one_of_each

BANDS, MINIMA = 40, 5
#: Bits up to which the trees find SimHashes that differ.
BITS = 2
#: Shingles of the documents in a tile.
TILE = 1 << 18
CACHED, BLOCK = 1_000_000, 4096
SLICE_BYTES = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


class WordHashes(dict):
    """64-bit codes of words; one cache per worker."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 5)
        return value


WORDS = WordHashes()


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * _FACTOR
    return codes ^ (codes >> np.uint64(29))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of shingles, sorted."""
    if len(WORDS) > CACHED:
        WORDS.clear()
    parts = text.lower().split()
    codes = np.fromiter(map(WORDS.__getitem__, parts), np.uint64, len(parts))
    length = min(words, len(parts))
    out = np.zeros(len(parts) - length + 1 if length else 0, np.uint64)
    for i in range(length):
        out = out * _FACTOR + codes[i:i + len(out)]
    return np.unique(_mixed(out))


def set_print(held: np.ndarray) -> int:
    """A hash of the set; 0 for the empty one."""
    return int(_mixed(_mixed(held).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(held))).view(np.int64)[0]) if len(held) else 0


def set_simhash(held: np.ndarray) -> int:
    """64 bits: each is set if it is set in over half of the shingles."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(held), 1 << 16):
        part = np.ascontiguousarray(held[first:first + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(held), bitorder="little").view(np.int64)[0])


def bands(held: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for first in range(0, len(held), BLOCK):
        least = np.minimum(least, (held[None, first:first + BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(MINIMA):
        key = _mixed(key) + least[k::MINIMA]
    return _mixed(key).view(np.int64)


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch, "text", SLICE_BYTES):
                sets = [shingles(t, words) for t in texts]
                keys = np.concatenate([bands(s) if len(s) else np.zeros(BANDS, np.int64) for s in sets])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[row:row + len(texts)], pa.array([set_print(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([set_simhash(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))],
                    ["doc_id", "fp", "n", "sim", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, "text", SLICE_BYTES):
                sets = [shingles(t, words) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([set_print(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["fp", "held"])

    return run


def set_prints(words: int):
    """A column function text -> hash of the set of shingles."""

    @F.arrow_udf("bigint")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([set_print(shingles(t, words)) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], pa.int64())

    return of


def alike_sets(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Pairs that connect all sets of similarity ``similar`` or more. Sets that hang together already
    are not compared again."""
    sizes, label, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    codes = np.concatenate(sets)
    order = np.argsort(codes, kind="stable")
    owner, codes = np.repeat(np.arange(len(sets)), sizes)[order], codes[order]
    for i in range(len(sets)):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        open_ = (label != label[i]) & (small >= similar * large - 1e-9)
        open_[:i] = False
        if not open_.any():
            continue
        begins, ends = np.searchsorted(codes, sets[i], "left"), np.searchsorted(codes, sets[i], "right")
        shared = np.zeros(len(sets), np.int64)
        n = ends - begins
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared += np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(open_ & (shared >= similar * (sizes + sizes[i] - shared) - 1e-9)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _verify(similar: float):
    def run(group: pa.Table) -> pa.Table:
        at = dict(zip(group.column("fp").to_pylist(), range(len(group))))
        ids, held = sorted(at), group.column("held").combine_chunks()
        links = alike_sets([held[at[i]].values.to_numpy().view(np.uint64) for i in ids], similar)
        return pa.table({"a": pa.array([ids[a] for a, _ in links], pa.int64()), "b": pa.array([ids[b] for _, b in links], pa.int64())})

    return run


def tree_links(kinds: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect sets (fp, n, sim) whose SimHashes differ in at most ``bits`` bits: by the trees
    over the distinct ones, each standing for its smallest fp."""
    prints = stored(kinds.where("n > 0").groupBy("sim").agg(F.min("fp").alias("m")), "shingle-prints")
    found = fingerprint_links(prints.select(F.col("sim").alias("fp")), bits)
    one, two = (prints.select(F.col("sim").alias(k), F.col("m").alias(f"m{k}")) for k in "ab")
    apart = found.join(one, "a").join(two, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    same = kinds.where("n > 0").join(prints, "sim").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return apart.unionByName(same)


def band_links(kinds: DataFrame) -> DataFrame:
    """Links (a, b) that connect sets (fp, n, bands) that share a band."""
    keys = kinds.where("n > 0").select("fp", F.explode("bands").alias("key"))
    least = stored(keys.groupBy("key").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m < x").select("key", "m"), "shared-bands")
    return keys.join(least, "key").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))


def shingle_links(docs: DataFrame, signed: DataFrame, words: int, similar: float) -> DataFrame:
    """Links (a, b) between the hashes of sets that connect all sets that are alike."""
    kinds = stored(signed.groupBy("fp").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "shingle-kinds")
    near = tree_links(kinds).unionByName(band_links(kinds))
    hung = components(near).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    clusters = hung.unionByName(hung.select(F.col("cluster").alias("fp"), "cluster").distinct())  # a root is no node
    members = stored(kinds.select("fp", "first_id", "n").join(clusters, "fp"), "shingle-members")
    tiles = members.groupBy("cluster").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    of = stored(members.join(tiles, "cluster").select("fp", "cluster", "tiles"), "shingle-clusters")
    ids = members.select(F.col("first_id").alias("_first")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(words), "fp bigint, held array<bigint>").join(of, "fp").withColumn(
        "t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = sets.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "cluster", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "fp", "held")
    return pairs.groupBy("cluster", "t", "u").applyInArrow(_verify(similar), "a bigint, b bigint")


def shingle_groups(docs: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id, fp (a hash of its set of shingles), root (the smallest fp of its group)."""
    signed = stored(docs.select("doc_id", "text").mapInArrow(_signed(words), f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint, n bigint, sim bigint, bands array<bigint>"), "shingle-bands")
    roots = components(shingle_links(docs, signed, words, similar)).select(F.col("node").alias("fp"), "root")
    return signed.select("doc_id", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


@sheltered("doc_id", "text")
def shingle_dedup(docs: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """docs with one row of each group: that of the smallest id."""
    return one_of_each(docs, shingle_groups(docs, words, similar), set_prints(words))
