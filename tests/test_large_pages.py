"""The visible text of a page costs as much per tag on a large page as on a small one."""

import time

from pyspark.sql import functions as F

from veilspan.operators.html import nodes, text_stream, visible_text


def seconds(spark, pairs: int) -> float:
    pages = spark.createDataFrame([("<p>a &amp; b</p>" * pairs,)], "html string")
    begun = time.time()
    row = pages.select(visible_text(F.col("html")).alias("text"), F.size(text_stream(nodes(F.col("html")))).alias("n")).first()
    assert row["text"] == "\na & b\n" * pairs and row["n"] == 3 * pairs
    return time.time() - begun


def test_large_page(spark):
    seconds(spark, 10)  # compiled
    small = min(seconds(spark, 1_000) for _ in range(3))
    assert seconds(spark, 40_000) < 40 * max(small, 0.25)


def test_hidden_runs(spark):
    html = "a<style>b<p>c<script/>d<style>e</style>f</style>g</style>h<script>i"
    row = spark.createDataFrame([(html,)], "html string").select(text_stream(nodes(F.col("html"))).alias("n")).first()
    assert [(n["raw"], n["start"]) for n in row["n"] if n["shown"]] == [("a", 0), ("g", 2), ("h", 3)]
