"""Terms that begin alike: what meets a text must not grow with the number of such terms."""

from pyspark.sql import functions as F

from veilspan.operators import words as wd


def test_terms_that_begin_alike_are_keyed_apart(spark):
    n = 300
    terms = spark.range(n).select(F.concat(F.lit("REF-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" of www.example.com")).alias("term"))
    keyed = wd.terms_by_run(terms)
    assert keyed.groupBy("first").count().agg(F.max("count")).first()[0] == 1
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("see REF-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" of www.example.com.")).alias("text"))
    tokens = wd.explode_runs(docs, [wd.RUN])
    assert tokens.join(keyed, "first").count() == n


def test_join_finds_what_the_literal_finds(spark):
    terms = [("REF-1", True), ("REF-1-2", False), ("a.b", True), ("(x) y", True), ("one two three four", True), ("Host name", False), ("solo", True), ("über Maß", True), ("-- !", True)]
    texts = ["ref-1-2 REF-1-2, a.b.c A.B", "(x) y z(x) yy", "One two three four. one two  three four", "c:\\nHost name \\tsolo \\nsolo xsolo", "ÜBER Maß one two three", "", None,
             "w " * 400 + "one two three four" + " w" * 400]
    frame = spark.createDataFrame(terms, "term string, ci boolean").withColumn("payload", F.create_map(F.lit("k"), F.col("term")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for escapes in (False, True):
        rows = [{(r["doc_id"], o["start"], o["end"], o["text"], o["term"], o["payload"]["k"]) for r in wd.with_occurrences(docs, frame, escapes=escapes, inline_limit=limit, broadcast_limit=wide).collect()
                 for o in r["occurrences"] or []} for limit, wide in ((100, 100), (0, 100), (0, 0))]
        assert rows[0] and rows[0] == rows[1] == rows[2]
