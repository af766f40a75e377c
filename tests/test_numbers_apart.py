"""A number is not lost because another one follows, nor an address behind a word like ``ver``."""

from veilspan.operators.detect import explode_spans, find_spans

TEXTS = {
    "call +1 (208) 555-1177 4284896609045836": {("PHONE", "+1 (208) 555-1177"), ("CREDIT_CARD", "4284896609045836")},
    "call +1 (608) 555-2280 37": {("PHONE", "+1 (608) 555-2280")},
    "call +49 30 1234567 4284896609045836": {("PHONE", "+49 30 1234567"), ("CREDIT_CARD", "4284896609045836")},
    "call +49 30 123456-78": {("PHONE", "+49 30 123456-78")},
    "4451718024887799 53.121.55.90 42 4366089147969128": {("CREDIT_CARD", "4451718024887799"), ("IPV4", "53.121.55.90"), ("CREDIT_CARD", "4366089147969128")},
    "card 5555 5555 5555 4444 37, 37 5555-5555-5555-4444": {("CREDIT_CARD", "5555 5555 5555 4444"), ("CREDIT_CARD", "5555-5555-5555-4444")},
    "zu ver 42.244.84.203 ist": {("IPV4", "42.244.84.203")},
    "ver. 2.3.4.5 und ver: 2.3.4.5, release 2.3.4.5": set(),
}


def test_numbers_apart(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = explode_spans(find_spans(docs, detectors=("phone", "creditcard", "ipv4")), "doc_id").collect()
    got = {text: {(r["type"], r["text"]) for r in rows if r["doc_id"] == k} for k, text in enumerate(TEXTS)}
    assert got == TEXTS
