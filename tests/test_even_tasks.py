"""Tasks that make texts of narrow rows get few rows each; long lists of findings cost in proportion."""

from pyspark.sql import functions as F

from veilspan.functions.tables import ROWS_PER_TASK
from veilspan.operators.modes import redact
from veilspan.operators.spans import resolve
from veilspan.plans.base import derived


def test_rows_of_one_split_are_dealt_out(spark, tmp_path):
    spark.range(25 * ROWS_PER_TASK).coalesce(1).write.parquet(f"{tmp_path}/many.parquet")
    texts = derived(spark, str(tmp_path), "many", "id", "cast(id as string)")
    sizes = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 25 * ROWS_PER_TASK and max(sizes) < 1.2 * ROWS_PER_TASK


def test_blocks_of_spans_meet_without_loss(spark):
    """Sizes around the borders of blocks and stretches, with letters of several bytes between."""
    sizes = [1, 2, 63, 64, 65, 128, 2047, 2048, 2049, 5000]
    texts = [(n, " ".join(f"hôst € 10.{i % 250}.{i // 250}.7 😀up" for i in range(n))) for n in sizes]
    out = redact(spark.createDataFrame(texts, "n int, text string"), "<{type}>", detectors=("ipv4",))
    for r in out.collect():
        want = " ".join(["hôst € <IPV4> 😀up"] * r["n"])
        assert r["output"] == want and len(r["replacements"]) == r["n"]
        assert all(want[p["out_start"]:p["out_end"]] == "<IPV4>" and r["text"][p["in_start"]:p["in_end"]] == p["original"] for p in r["replacements"])


def test_clusters_reach_over_blocks(spark):
    """A long span over many blocks clashes with each inside it; the ones behind it stand for themselves."""
    spans = [(0, 3000, 20)] + [(10 * k, 10 * k + 5, 10) for k in range(600)]
    made = spark.createDataFrame([([(s, e, "X", "t", "d", p, {}) for s, e, p in spans],)],
                                 "v array<struct<start:int,end:int,type:string,text:string,detector:string,priority:int,meta:map<string,string>>>")
    got = [(x["start"], x["end"]) for x in made.select(resolve(F.col("v")).alias("r")).first()["r"]]
    top = [(0, 3000)] + [(10 * k, 10 * k + 5) for k in range(300, 600)]
    assert got in (top, sorted((s, e) for s, e, _ in spans[1:]))
