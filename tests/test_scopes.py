"""Slices of a text against the whole text, at all cut points; names within a scope."""

import pytest
from pyspark.sql import functions as F

from veilspan.operators.detect import find_spans
from veilspan.operators.scopes import find_spans_in_scope, find_spans_sliced, slices

DETECTORS = ("email", "ipv4", "ipv6", "mac", "iban", "creditcard", "phone", "domain", "learned-names", "tracking")
BASE = ("Jonas Brandt und Maria Falk, maria.falk@zeta-test.de,\nIPv6 2a02:8100:1:2::abcd IBAN DE89 3704 0044 0532 0130 00 Karte 5555 5555 5555 4444\fBrandt "
        "MAC 02:1A:2B:3C:4D:5E Tel. +49 30 1234567 jonas.brandt@acme-test.de https://x.example/?utm_source=a&id=7 10.20.30.40/24 Falk Ria ")


def rows(df):
    return {r.doc_id: [(s.start, s.end, s.type, s.text, s.detector) for s in r.spans] for r in df.collect()}


@pytest.mark.parametrize("size", [130, 211])
def test_slices_find_what_the_whole_text_has(spark, size):
    """The text moves letter by letter against the cuts, so every place is a cut once."""
    texts = [(k, ("x" * (k % 7) + " ") * (k // 8) + "." * (k % 8) + BASE * 2) for k in range(size + 2)]
    docs = spark.createDataFrame([*texts, (9001, None), (9002, ""), (9003, "kurz a.b@zeta-test.de")], "doc_id int, text string").repartition(4)
    want, got = rows(find_spans(docs, DETECTORS)), rows(find_spans_sliced(docs, DETECTORS, size=size, overlap=80))
    assert got == want and sum(map(len, want.values())) > 15 * size


def test_slices_cover_the_text(spark):
    text = "line of text\n" * 50 + "y" * 500 + "\f" + "z" * 90
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "doc_id int, text string")
    parts = {}
    for r in slices(docs, 100, 20).orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(r)
    assert [(r.begin, r.end, r.text) for r in parts[2]] == [(0, 5, "short")] and parts[4][0].text is None
    assert "".join(text[r.begin:r.end] for r in parts[1]) == text and all(0 < r.end - r.begin <= 100 for r in parts[1])
    assert all(r.text == text[r.start:r.end + 20] and r.start == max(0, r.begin - 20) for r in parts[1])
    assert all(r.cut_left == (r.start > 0) and r.cut_right == (r.end + 20 < len(text)) for r in parts[1])


def test_names_stay_in_their_scope(spark):
    texts = [(1, "a", "mail mia.falk@acme-test.de"), (2, "a", "Mia Falk, FALK, falk, Falk-Land, xFalk, Falk_1"), (3, "b", "Mia Falk"), (4, "c", "Rob Moor"), (5, None, "Mia")]
    docs = spark.createDataFrame(texts, "doc_id int, scope string, text string")
    known = spark.createDataFrame([("c", "moor", "last"), ("a", "mia", "last")], "scope string, token string, kind string")
    found = find_spans_in_scope(docs, "scope", ("email", "learned-names"), known=known)
    got = {(r.doc_id, s.text, s.meta.get("kind")) for r in found.collect() for s in r.spans if s.type == "PERSON"}
    assert got == {(2, "Mia", "last"), (2, "Falk", "last"), (2, "FALK", "last"), (4, "Moor", "last")}
