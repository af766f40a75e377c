"""What is not replaced in a text node stays as it is written."""

from veilspan.operators.html import process_html
from veilspan.operators.modes import redact


def test_character_references_stay(spark):
    rows = {
        "<p>a = &quot;b&quot;### mia@acme-test.de### c &amp; d &nope; 5 > 3 &#65;</p>": "<p>a = &quot;b&quot;### <EMAIL>### c &amp; d &nope; 5 > 3 &#65;</p>",
        "<p>&auml;&#x1F600; mia&#64;acme-test.de &copy;, eva@acme-test.de&gt;</p>": "<p>&auml;&#x1F600; <EMAIL> &copy;, <EMAIL>&gt;</p>",
        "<p>&lt;<b>mia@ac</b>me-test.de&lt; it's</p>": "<p>&lt;<b><EMAIL></b>&lt; it's</p>",
    }
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, html string")
    out = process_html(docs, lambda t: redact(t, "<{type}>", detectors=("email",)))
    got = {r["html"]: r["output"].replace("&lt;EMAIL&gt;", "<EMAIL>") for r in out.select("html", "output").collect()}
    assert got == rows
