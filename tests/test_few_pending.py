"""Few keys that look for a value do not move the values that are taken."""

from pyspark.sql import functions as F

from veilspan.functions.tables import not_taken


def test_few_and_many_keep_the_same(spark):
    proposed = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    taken = spark.createDataFrame([(1,), (3,), (3,), (99,)], "v long")
    kept = [sorted(map(tuple, not_taken(proposed, taken, ["v"], few).collect())) for few in (False, True)]
    assert kept[0] == kept[1] and {v for v, _ in kept[0]} == {0, 2, 4, 5, 6}
    assert "SortMergeJoin" not in not_taken(proposed, taken, ["v"], True)._jdf.queryExecution().executedPlan().toString()
