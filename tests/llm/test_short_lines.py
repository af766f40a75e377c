"""Short lines that are repeated exactly, through the registered query."""

from veilspan.llm.queries import op3_fuzzy_lines


def test_short_lines_are_merged(spark, tmp_path):
    texts = ["All rights reserved.\n\nfirst text", "ALL rights reserved\n\n---\nsecond text", "---\n今日は良い天気です", "今日は良い天気です。\nAll rights", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in op3_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {0: (3, 0), 1: (4, 1), 2: (2, 0), 3: (2, 1), 4: (1, 0)}
