"""Texts and attribute values of pages come from one reading of the pages."""

from pyspark.sql import functions as F

from veilspan.operators.html import process_html


def test_pages_are_read_once_for_texts_and_attributes(spark, tmp_path):
    pages = [(1, '<i title="ab">a<b>b</b></i><script x="ab">ab</script><!-- ab -->'), (2, None), (3, ""), (4, "<i lang='ab'>ab</i>"), (None, "ab")]
    spark.createDataFrame(pages, "doc_id int, html string").write.parquet(str(tmp_path / "pages"))
    given = []

    def process(texts):
        given.append(texts)
        found = F.when(F.col("text") == "ab", F.array(F.struct(
            F.lit(0).alias("in_start"), F.lit(2).alias("in_end"), F.lit("CUSTOM").alias("type"), F.lit("d").alias("detector"), F.lit("X").alias("replacement"))))
        kind = "array<struct<in_start:int,in_end:int,type:string,detector:string,replacement:string>>"
        return texts.withColumn("replacements", F.coalesce(found, F.array().cast(kind))).withColumn("output", F.when(F.col("text") == "ab", "X").otherwise(F.col("text")))

    out = process_html(spark.read.parquet(str(tmp_path / "pages")), process)
    assert {(r.doc_id, r.output) for r in out.collect()} == {(1, '<i title="X">X<b></b></i>'), (2, None), (3, ""), (4, "<i lang='ab'>X</i>"), (None, "ab")}
    assert given[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
