"""Sharding through fixed virtual slots: built-in functions only.

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and a slot map says
which shard a slot belongs to. The map is small (one number per slot), versioned and edited when
shards are added: only the slots that the new shard takes over move. No record is looked at again.

Null texts have no bytes; a null id hashes like any other value; repeated rows share a slot.
Equal ids with different texts may be in different slots. An empty table has an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspan.llm.common import free_name, new_folder, stored

SLOTS = 8192
#: Bytes that a record costs besides its text.
RECORD_BYTES = 16


def _literal(values: list[int]) -> Column:
    """An array literal as one folded string: quick to plan and no table to join."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot belongs to. ``slots`` numbers, whatever the size of the corpus."""

    shards: int
    version: int
    shard_of: tuple[int, ...]

    def shard(self, slot: Column) -> Column:
        return F.element_at(_literal(list(self.shard_of)), slot + 1).cast("int")

    def save(self, spark: SparkSession, root: str) -> str:
        """A version is a folder of its own; older versions stay readable."""
        path = f"{root}/version={self.version}"
        spark.range(len(self.shard_of)).select(
            F.col("id").cast("int").alias("slot"), self.shard(F.col("id").cast("int")).alias("shard"), F.lit(self.shards).alias("shards"),
        ).coalesce(1).write.mode("errorifexists").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, root: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{root}/version={version}").orderBy("slot").collect()  # one row per slot
        return SlotMap(rows[0]["shards"], version, tuple(r["shard"] for r in rows))

    def grow(self, loads: list[int]) -> SlotMap:
        """One more shard: it takes slots from the fullest shards until it holds its share of the
        bytes. All other slots stay where they are."""
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        total = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            held[shard].append((loads[slot], slot))
            total[shard] += loads[slot]
        for slots in held:
            slots.sort()
        share, taken, new = sum(loads) / (self.shards + 1), 0, list(self.shard_of)
        while taken < share:
            shard = max((s for s in range(self.shards) if held[s]), key=lambda s: (total[s], -s), default=None)
            if shard is None or total[shard] <= share:
                break
            fits = [x for x in held[shard] if taken + x[0] <= share]
            if not fits:
                break
            size, slot = fits[-1]
            held[shard].remove((size, slot))
            total[shard] -= size
            taken += size
            new[slot] = self.shards
        return SlotMap(self.shards + 1, self.version + 1, tuple(new))


def text_crc32() -> Column:
    return F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint")


def virtual_slot(slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64("doc_id", text_crc32()), F.lit(slots)).cast("int")


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size: UTF-8 bytes and what a record costs, text_crc32, virtual_slot)."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("bigint")
    return docs.select("doc_id", size.alias("size"), text_crc32().alias("text_crc32"), virtual_slot(slots).alias("virtual_slot"))


def slot_loads(sized: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; ``slots`` numbers each come to the driver at most."""
    size, rows = [0] * slots, [0] * slots
    for r in sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def plan(loads: list[int], shards: int, version: int = 1) -> SlotMap:
    """Largest slot first to the shard with the fewest bytes; ties go by number, so reruns agree."""
    fill = [(0, s) for s in range(shards)]
    shard_of = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda k: (-loads[k], k)):
        size, shard = heapq.heappop(fill)
        shard_of[slot] = shard
        heapq.heappush(fill, (size + loads[slot], shard))
    return SlotMap(shards, version, tuple(shard_of))


def current_map(spark: SparkSession, root: str, loads: list[int], shards: int) -> SlotMap:
    """The newest map in ``root``, edited until it has the shards asked for and stored as the next version;
    a new map if there is none. Fewer shards than it has are no edit: an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    if not versions:
        slot_map = plan(loads, shards)
        slot_map.save(spark, root)
        return slot_map
    slot_map = SlotMap.load(spark, root, max(versions))
    if slot_map.shards > shards:
        raise ValueError(f"the map has {slot_map.shards} shards already")
    while slot_map.shards < shards:
        slot_map = slot_map.grow(loads)
        slot_map.save(spark, root)
    return slot_map


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, root: str | None = None) -> tuple[DataFrame, SlotMap]:
    """docs + virtual_slot, shard, and the map. One aggregation over two narrow columns; the texts are not
    shuffled. The map is kept in ``root``: a job that names the folder of an earlier one goes on with its
    map, edited if there are more shards. If docs has a column of such a name, the new one gets a number
    behind it (``shard_2``)."""
    spark = docs.sparkSession
    slot_map = current_map(spark, root or new_folder(spark, "slot-map"), slot_loads(with_slot(docs, slots), slots)[0], shards)
    slot = virtual_slot(slots)
    return docs.withColumns({free_name(docs, "virtual_slot"): slot, free_name(docs, "shard"): slot_map.shard(slot)}), slot_map


def positions(docs: DataFrame, shards: int, slots: int = SLOTS, root: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot): ``slot`` is the place within the shard,
    0 and up without a gap. Rows are only numbered within a virtual slot; where a virtual slot begins
    in its shard follows from the row counts per slot. The map is kept in ``root``, as for ``shard``."""
    sized = stored(with_slot(docs, slots), "sized")
    loads, rows = slot_loads(sized, slots)
    slot_map = current_map(docs.sparkSession, root or new_folder(docs.sparkSession, "slot-map"), loads, shards)
    begin, begins = [0] * shards, [0] * slots
    for slot, owner in enumerate(slot_map.shard_of):
        begins[slot] = begin[owner]
        begin[owner] += rows[slot]
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return sized.withColumn("_n", F.row_number().over(order) - 1).select(
        "doc_id", "size", "text_crc32", slot_map.shard(F.col("virtual_slot")).alias("shard"),
        (F.element_at(_literal(begins), F.col("virtual_slot") + 1) + F.col("_n")).alias("slot"), "virtual_slot")
