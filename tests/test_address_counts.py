"""The counts of a text have the address behind the word ``ver``, as their SQL has."""

import duckdb

from veilspan.plans import QUERIES


def test_counts_map_behind_ver(spark, tmp_path):
    texts = ["enöü zu ver 42.244.84.203 ist", "der ver 57.236.223.213 und 16.160.228.243", "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["counts_map"].run(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(QUERIES["counts_map"].sql).fetchall()) == {(0, 1), (1, 2), (2, 0), (3, 0)}
