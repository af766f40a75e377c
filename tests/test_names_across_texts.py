"""Names that one text teaches are replaced in another one: without that step the query has no rows."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspan.operators import modes


def test_names_are_translated_in_another_text(spark, tmp_path, monkeypatch):
    names = [(k, f"Customer#{k}") for k in range(1, 9)]
    spark.createDataFrame([*names, (10, None)], "c_custkey bigint, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    run = entry.queries()["names_across_texts"]
    got = run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [2, 4, 6, 8] and all(r.original.startswith("mia.falk") for r in got)
    # the project's names are not looked for
    monkeypatch.setattr(modes, "_learned_by_project", lambda docs, *_: docs.withColumn("_learned", F.array().cast(modes.FINDINGS)))
    assert run(spark, str(tmp_path)).collect() == []
