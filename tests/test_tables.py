"""When a lookup table may be broadcast, and that both ways join alike."""

from pyspark.sql import functions as F

from veilspan.functions.tables import lookup, may_be_broadcast


def test_size_counts_rows_and_bytes(spark):
    ids = spark.range(1000)
    assert may_be_broadcast(ids) and not may_be_broadcast(ids, rows=999) and not may_be_broadcast(ids, rows=0) and may_be_broadcast(ids.limit(0))
    wide = ids.select("id", F.repeat(F.lit("x"), F.lit(100)).alias("a b"))
    assert may_be_broadcast(wide, size=200_000) and not may_be_broadcast(wide, size=100_000)
    nested = ids.select(F.create_map(F.lit("k"), F.repeat(F.lit("y"), F.lit(200))).alias("m"), F.lit(None).cast("string").alias("n"))
    assert may_be_broadcast(nested, size=300_000) and not may_be_broadcast(nested, size=150_000)


def test_both_ways_join_alike(spark):
    left = spark.createDataFrame([(k, k % 3) for k in range(50)] + [(99, None)], "n int, key int")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "key int, v string")
    for how, rows in (("left", 51), ("inner", 34)):
        broadcast, salted = (sorted(map(repr, lookup(left, right, ["key"], F.col("n"), how, limit).collect())) for limit in (10, 0))
        assert broadcast == salted and len(broadcast) == rows
