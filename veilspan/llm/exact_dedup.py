"""Exact dedup with an index of cuckoo filters over the live digests.

A digest is the SHA-256 of a normalised text. Digests are dealt to buckets; each bucket holds a
cuckoo filter and the content behind it (digest, smallest id, number of rows). A digest that the
filter does not know is new. A hit is verified against the content, as filters have false hits.
Deleting takes the fingerprint of a digest out when its last row goes. A filter that overflows is
rebuilt with twice the room from the stored digests. The index is a table: one batch after another
updates it, so new crawls are checked without a look at old texts.

Null texts count as empty and equal the empty text; texts of only blanks are one blank. Rows with a
null id never win over an id. Rows that repeat an id and a text count in ``group_size``; one of them
is kept. An empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import BLANKS, stored, text_or_empty

ENTRIES = 4  # fingerprints in a filter bucket
KICKS = 200
STATE = "bucket int, digest binary, keep_id bigint, group_size bigint, filter binary"
#: Digests of one index bucket, at which more buckets are wanted.
BUCKET_DIGESTS = 50_000
LEAST_BUCKETS = 1024


class Overflow(Exception):
    """A fingerprint found no place."""


class CuckooFilter:
    """Fingerprints of 32 bits in buckets of four, for arrays of 64-bit hashes."""

    def __init__(self, buckets: int = 256, cells: np.ndarray | None = None):
        self.cells = np.zeros((buckets, ENTRIES), np.uint32) if cells is None else cells
        self.mask = np.uint64(len(self.cells) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        one = (hashes & self.mask).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = prints.astype(np.uint64) * np.uint64(0x5BD1E995)
        return ((place.astype(np.uint64) ^ (step ^ (step >> np.uint64(15)))) & self.mask).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(hashes)
        return (self.cells[one] == prints[:, None]).any(1) | (self.cells[two] == prints[:, None]).any(1)

    def _settle(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Put fingerprints into free cells of their places; a mask of those that found none."""
        left = np.ones(len(place), bool)
        for cell in range(ENTRIES):
            can = np.flatnonzero(left & (self.cells[place, cell] == 0))
            if len(can):
                can = can[np.unique(place[can], return_index=True)[1]]
                self.cells[place[can], cell] = prints[can]
                left[can] = False
        return left

    def insert(self, hashes: np.ndarray) -> None:
        prints, one, two = self._places(hashes)
        left = self._settle(one, prints)
        prints, place = prints[left], two[left]
        left = self._settle(place, prints)
        prints, place = prints[left], place[left]
        for kick in range(KICKS):
            if not len(prints):
                return
            first = np.unique(place, return_index=True)[1]
            cell = kick % ENTRIES
            out = self.cells[place[first], cell].copy()
            self.cells[place[first], cell] = prints[first]
            waiting = np.ones(len(prints), bool)
            waiting[first] = False
            prints = np.concatenate([out, prints[waiting]])
            place = np.concatenate([self._other(place[first], out), place[waiting]])
            left = self._settle(place, prints)
            prints, place = prints[left], place[left]
        raise Overflow

    def delete(self, hashes: np.ndarray) -> None:
        """Take out one fingerprint each. Only digests that are in the index may be deleted."""
        for one_print, *places in zip(*self._places(hashes)):
            for place in places:
                cells = np.flatnonzero(self.cells[place] == one_print)
                if len(cells):
                    self.cells[place, cells[0]] = 0
                    break


class Bucket:
    """One bucket of the index inside a task: the filter and the content that hits verify against."""

    def __init__(self, state: pa.Table):
        self.rows: dict[bytes, list] = {}
        self.filter = CuckooFilter()
        for digest, keep, size, cells in zip(*(state.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "filter"))):
            if cells is not None:
                self.filter = CuckooFilter(cells=np.frombuffer(cells, np.uint32).reshape(-1, ENTRIES).copy())
            else:
                self.rows[digest] = [keep, size]

    @staticmethod
    def hashes(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)

    def add(self, digests: list[bytes], ids: list, sizes: list) -> None:
        new = []
        for digest, hit, keep, size in zip(digests, self.filter.contains(self.hashes(digests)).tolist(), ids, sizes):
            row = self.rows.get(digest) if hit else None
            if row is None:
                new.append(digest)
                self.rows[digest] = [keep, size]
            else:
                row[0] = keep if row[0] is None else row[0] if keep is None else min(row[0], keep)
                row[1] += size
        if new:
            try:
                self.filter.insert(self.hashes(new))
            except Overflow:
                self._resize()

    def remove(self, digests: list[bytes], sizes: list) -> None:
        """Take rows of live digests away; a digest without rows leaves content and filter. The
        smallest id stays as it is: which ids are left is not known here (see ``update_index``)."""
        gone = []
        for digest, hit, size in zip(digests, self.filter.contains(self.hashes(digests)).tolist(), sizes):
            row = self.rows.get(digest) if hit else None
            if row is not None:
                row[1] -= size
                if row[1] <= 0:
                    del self.rows[digest]
                    gone.append(digest)
        if gone:
            self.filter.delete(self.hashes(gone))

    def _resize(self) -> None:
        buckets = len(self.filter.cells)
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            try:
                self.filter.insert(self.hashes(list(self.rows)))
                return
            except Overflow:
                continue

    def state(self, bucket: int) -> pa.Table:
        rows = self.rows
        return pa.table({
            "bucket": pa.array([bucket] * (len(rows) + 1), pa.int32()),
            "digest": pa.array([*rows, None], pa.binary()),
            "keep_id": pa.array([*(r[0] for r in rows.values()), None], pa.int64()),
            "group_size": pa.array([*(r[1] for r in rows.values()), None], pa.int64()),
            "filter": pa.array([*([None] * len(rows)), self.filter.cells.tobytes()], pa.binary()),
        })


def _update(key: tuple, state: pa.Table, batch: pa.Table) -> pa.Table:
    bucket = Bucket(state)
    for rows in batch.group_by(["digest", "live"]).aggregate([("keep_id", "min"), ("group_size", "sum")]).to_batches(max_chunksize=4096):
        for live in (True, False):
            part = rows.filter(pa.compute.equal(rows.column("live"), live))
            if len(part):
                digests, sizes = part.column("digest").to_pylist(), part.column("group_size_sum").to_pylist()
                if live:
                    bucket.add(digests, part.column("keep_id_min").to_pylist(), sizes)
                else:
                    bucket.remove(digests, sizes)
    return bucket.state(key[0].as_py())


def _combine(batches):
    """Rows of one digest in an Arrow batch become one, so a hot digest does not travel row by row."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["bucket", "digest", "live"]).aggregate([("keep_id", "min"), ("group_size", "sum")])
        yield from rows.rename_columns({"keep_id_min": "keep_id", "group_size_sum": "group_size"}).select(
            ["bucket", "digest", "live", "keep_id", "group_size"]).cast(_BATCH).to_batches()


_BATCH = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("live", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normal_text(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, from the whole text."""
    return docs.select("doc_id", F.unhex(F.sha2(normal_text(text_or_empty()), 256)).alias("digest"))


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def update_index(index: DataFrame, batch: DataFrame, buckets: int, live: bool = True, left: DataFrame | None = None) -> DataFrame:
    """The index after the rows of ``batch`` (doc_id, digest) were inserted, or taken out with
    ``live=False``. The number of buckets stays that of the index's first batch.

    When rows are taken out, ``left`` (doc_id, digest) are the rows that stay: the smallest ids of the
    digests in the batch are then taken from them. Without it they may name a row that is gone."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    rows = batch.select(bucket.alias("bucket"), "digest", F.lit(live).alias("live"), F.col("doc_id").cast("bigint").alias("keep_id"),
                        F.lit(1).cast("bigint").alias("group_size"))
    combined = rows.mapInArrow(_combine, "bucket int, digest binary, live boolean, keep_id bigint, group_size bigint")
    out = index.groupBy("bucket").cogroup(combined.groupBy("bucket")).applyInArrow(_update, STATE)
    if not live and left is not None:
        touched = batch.select("digest").distinct()
        least = left.join(touched, "digest", "left_semi").groupBy("digest").agg(F.min(F.col("doc_id").cast("bigint")).alias("_least"))
        known = touched.join(least, "digest", "left").withColumn("_touched", F.lit(True))
        out = out.join(known, "digest", "left").withColumn("keep_id", F.when(F.col("_touched"), F.col("_least")).otherwise(F.col("keep_id"))).select(*index.columns)
    return stored(out, "cuckoo-index")


def bucket_count(rows: int) -> int:
    """Follows the input, so a bucket has a bounded number of digests at any size."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_DIGESTS))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept."""
    read = stored(digests(docs), "digests")
    index = update_index(empty_index(docs.sparkSession), read, bucket_count(read.count()))
    content = index.where("digest is not null").select("digest", "keep_id", "group_size")
    counted = read.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))
    return counted.join(content, "digest").withColumn("_k", copies).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_k") == 1)).alias("kept"))


__all__ = ["Bucket", "CuckooFilter", "exact_dedup", "update_index"]
