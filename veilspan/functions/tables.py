"""Helpers for joins and lineage on a cluster."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast up to this many rows and bytes of values.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
# So few keys that look for a value are broadcast to the values that are taken.
FEW_PENDING = 200_000
# Copies of a lookup row when it is too large to broadcast: one hot key is spread over this many tasks.
SALT = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without the
    setting gets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut the lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition small rows with costly expressions over all cores. The explicit number keeps
    adaptive execution from packing them into few tasks because they are few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fill_cores(df: DataFrame) -> DataFrame:
    """Texts from fewer splits than there are cores (a small file with one row group) are dealt out;
    a table with more splits than cores stays as it is, so large inputs are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


# Rows of a table that a task makes texts of; what they cost is their work, not their bytes.
ROWS_PER_TASK = 20_000


def deal_rows(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Narrow rows of which texts are made are dealt out, so that a task gets about ``rows`` of them however
    large the table is: a split of few bytes may hold millions, and splits inside a row group are empty.
    Counting reads the footers of the files only."""
    wanted = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(wanted)


def at_most(df: DataFrame, n: int) -> bool:
    """Does the table have at most ``n`` rows? Reads no more than it needs."""
    return df.limit(n + 1).count() <= n


def may_be_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Is the table small, by rows and by bytes of its values? Counted by one aggregation, as rows may hold
    a URL or a map of any length."""
    if rows <= 0:
        return False
    fixed = {"int", "bigint", "double", "float", "boolean", "date", "timestamp", "smallint", "tinyint", "timestamp_ntz"}
    plain = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.col(f"`{c}`") for c, t in df.dtypes if t not in fixed and t not in ("string", "binary")]
    width = reduce(lambda a, b: a + b, plain, F.lit(8 * len(df.columns) + 16))
    if nested:
        width = width + F.octet_length(F.to_json(F.struct(*nested)))
    n, total = df.agg(F.count(F.lit(1)), F.sum(width.cast("bigint"))).first()
    return n <= rows and (total or 0) <= size


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left",
           limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large side that may hold hot keys with a table that is unique per key.

    A small table is broadcast after its rows and bytes were counted. A large one is shuffled with a salt:
    the rows of a hot key are spread by ``spread`` (something that differs between them), the
    lookup rows are repeated per salt.
    """
    if may_be_broadcast(right, limit):
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def not_taken(proposed: DataFrame, taken: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Proposed rows whose values nobody has. ``few`` rows are broadcast to the values that are taken, which
    are many and stay where they are then."""
    if not few:
        return proposed.join(taken, keys, "left_anti")
    held = taken.select(*keys).join(F.broadcast(proposed.select(*keys).distinct()), keys, "left_semi").distinct()
    return proposed.join(F.broadcast(held), keys, "left_anti")


def claim(pending: DataFrame, candidate, keys: list[str], scope: list[str], taken: DataFrame | None,
          rounds: int, value: str = "surrogate") -> DataFrame:
    """Give every key its own value.

    Each round computes ``candidate(round)``; within ``scope`` the smallest key keeps a value
    nobody has, the others try again. Winners come from an aggregation with partial results, so
    thousands of keys that want one value do not meet in one task. Rounds end when no key is left.
    """
    done: list[DataFrame] = []
    few = False
    for n in range(rounds):
        proposed = pending.withColumn(value, candidate(n)).where(F.col(value).isNotNull())
        if taken is not None:
            proposed = not_taken(proposed, taken, [*scope, value], few)
        if done:
            proposed = not_taken(proposed, union_all([d.select(*scope, value) for d in done]), [*scope, value], few)
        winners = proposed.groupBy(*scope, value).agg(F.min(F.struct(*keys)).alias("_k")).select(
            *scope, value, *[F.col(f"_k.{k}").alias(k) for k in keys if k not in scope])
        won = cut(winners)
        done.append(won)
        pending = cut(pending.join(won.select(*keys), keys, "left_anti"))
        left = pending.count()
        if not left:
            return union_all(done)
        few = left <= FEW_PENDING
    raise RuntimeError(f"{pending.count()} keys without a value of their own after {rounds} rounds")
