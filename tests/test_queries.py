"""Registered queries against DuckDB on the smallest tables, and streams."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

QUICK = (
    "find_email", "find_card", "find_iban", "find_company", "find_tracking", "find_hex_strings", "plausible_entities", "quality",
    "resolve_by_priority", "resolve_by_length", "highlight_spans", "clean_url", "unwrap_url", "html_visible_text", "history_latest",
    "build_dictionary", "common_words", "decode_files", "checksums", "ip_classes", "dictionary_occurrences", "dictionary_join",
    "box_union", "box_merge", "box_best", "box_ocr", "windowed_counts", "sliding_counts", "session_counts", "stream_settled",
    "long_secrets", "dense_text", "wrapped_targets", "type_overrides", "infra_vocabulary", "unchanged_replacements", "top_findings",
    "box_totals", "char_positions", "own_events", "paused_events", "expired_secrets", "expired_out_of_order", "stream_counts", "phrase_occurrences", "phrase_join", "sql_find_spans", "failing_detectors",
)


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(plain(dict(zip(names, row))[c]) for c in columns)) for row in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lone_secret_expires(spark, tmp_path):
    """Scheduled, cleared after the time; cancelled by another text; kept when asked to."""
    from veilspan.streaming.watch import SECRET_EVENT, expire_secrets, rocksdb

    folder = str(tmp_path / "in")
    rows = [
        ("a", "2024-01-01 00:00:00", "x", "lone_secret"), ("a", "2024-01-01 00:02:00", "n", "none"),
        ("b", "2024-01-01 00:00:00", "y", "lone_secret"), ("b", "2024-01-01 00:00:30", "n", "none"), ("b", "2024-01-01 00:02:00", "n", "none"),
        ("c", "2024-01-01 00:00:00", "z", "lone_secret"), ("c", "2024-01-01 00:00:10", "z", "keep"), ("c", "2024-01-01 00:00:20", "z", "lone_secret"),
    ]
    spark.createDataFrame(rows, "source_id string, t string, h string, decision string").select(
        "source_id", F.to_timestamp("t").alias("ts"), "h", "decision").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("source_id string, ts timestamp, h string, decision string").parquet(folder)
    out = str(tmp_path / "out")
    with rocksdb(spark):
        expire_secrets(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["source_id"], r["kind"]) for r in spark.read.schema(SECRET_EVENT).parquet(out).collect()}
    assert got == {("a", "scheduled"), ("a", "clear"), ("b", "scheduled"), ("c", "scheduled")}
