"""The texts' words that no term has do not travel; an escape may stand at the end of a segment."""

from pyspark.sql import functions as F

from veilspan.operators import words as wd


def test_only_runs_that_may_be_keys_travel(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Ünter den "), F.col("id").cast("string"), F.lit(" Linden, ÜNTER")).alias("text"))
    keys = spark.createDataFrame([("ünter",), ("den 7 linden",), ("7 linden",), ("absent word here",)], "first string")
    got = wd.explode_runs(docs, [1, 2, 3], bits=wd.run_bits(keys)).collect()
    assert sorted((r["doc_id"], r["start"], r["first"]) for r in got) == sorted(
        [(k, s, "ünter") for k in range(40) for s in (0, len(f"Ünter den {k} Linden, "))] + [(7, 6, "den 7 linden"), (7, 10, "7 linden")])


def test_escape_at_the_end_of_a_segment(spark):
    docs = spark.createDataFrame([(1, "." * 511 + "\\nHost up")], "doc_id int, text string")
    terms = spark.createDataFrame([("Host up", False)], "term string, ci boolean")
    for limit in (100, 0):
        found = wd.with_occurrences(docs, terms, escapes=True, inline_limit=limit).first()["occurrences"]
        assert [(o["start"], o["text"]) for o in found] == [(513, "Host up")]
