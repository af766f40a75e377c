"""Toxicity: features against plain counts, the lexicon against plain counts, held-out accuracy, odd tables."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspan.llm.queries import QUERIES
from veilspan.llm.toxicity import FEATURES, HIDDEN, KNOWN, LEARNED, LONG_DRAWN, MIXED, SHOUTED, SINGLE, YOU, Words, features, learn_lexicon, normal_forms, terms


def run(spark, path):
    return {r.doc_id: r for r in QUERIES["op11_boosted_toxicity"][0](spark, str(path)).collect()}


def away(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_normal_forms():
    want = {"Idiot!!!": ("idiot", "idiot"), "1d1ot": ("1d1ot", "idiot"), "st*pid": ("st*pid", "stpid"), "$tupid,": ("tupid", "stupid"),
            "looooser": ("looooser", "loser"), "2024": ("2024", "2024"), "---": ("", ""), "É": ("é", "é"), "": ("", "")}
    assert {w: normal_forms(w) for w in want} == want


def test_codes_of_words():
    words = Words({"grom$": 1.0, "blat": 0.5})
    flags = lambda w: words.code(w.encode()) & 255
    assert flags("GROM") == LEARNED | SHOUTED and words.code(b"blatter") == LEARNED | 127 << 8 and not flags("gromm") and not flags("blat")
    assert flags("gr0m") == LEARNED | HIDDEN | MIXED and flags("you") == YOU and flags("idiot,") == KNOWN
    assert flags("1d10t") == KNOWN | HIDDEN | MIXED and flags("heyyyy") == LONG_DRAWN and flags("x") == SINGLE


def test_features_of_texts():
    words = Words({"grom$": 1.0})
    f = features(b"You are a GROM!! and that is one two three four grom.", words)
    assert len(f) == FEATURES and f[0] == pytest.approx(2 / 12) and f[5] == pytest.approx(1 / 12) and f[7] == pytest.approx(1 / 12)
    for odd in (b"", b" \n", b"\xff\xfe broken", "é ü".encode(), b"a" * 100_000):
        assert len(features(odd, words)) == FEATURES and all(map(math.isfinite, features(odd, words)))


def test_lexicon_counts_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([rng.choice(["sun", "moon", "Star,"]) for _ in range(9)] + (["grommel", "Grommit!"] if i % 4 == 0 else [])), float(i % 4 == 0))
            for i in range(200)]
    got = learn_lexicon(spark.createDataFrame(rows, "doc_id int, text string, label double").select("doc_id", "text").repartition(5),
                        spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id int, label double"))
    toxic, clean = Counter(), Counter()
    for _, text, label in rows:
        (toxic if label else clean).update({t for w in text.split() for form in normal_forms(w) for t in terms(form)})

    def z(t):
        a, b = toxic[t], clean[t]
        odds = math.log((a + 0.5) / (50 - a + 0.5)) - math.log((b + 0.5) / (150 - b + 0.5))
        return odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))

    assert set(got) == {t for t in toxic if toxic[t] >= 3 and z(t) >= 3} and {"gromm", "grommel$", "grommit$"} <= set(got) and "sun$" not in got


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got, labels = run(spark, sf), {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == away(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    kept = [(got[i].score, y) for i, y in labels.items() if i in got and away(i)]
    assert sum((s >= 0.5) == y for s, y in kept) >= 0.9 * len(kept)


def test_held_out_labels_do_not_teach(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "labels":
            df = df.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        else:
            df = df.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    score = lambda path: {i: round(r.score, 9) for i, r in run(spark, path).items()}
    assert score(sf) == score(tmp_path)


def test_odd_tables(spark, odd, empty, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 1), (3, 0, None), (None, 0, 1), (99_999, 1, 1), *((i, 0, i % 2) for i in range(4, 60))], none.schema)
    one = spark.createDataFrame([(i, 0, 1) for i in range(30)], none.schema)
    docs = odd.withColumns({c: F.lit("clash") for c in ("f", "features", "carried", "score", "p", "fold", "probability", "prediction")})
    for name, docs_, labels in (("some", docs, some), ("none", docs, none), ("one", docs, one), ("empty", empty, some), ("nothing", empty, none)):
        docs_.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = QUERIES["op11_boosted_toxicity"][0](spark, f"{tmp_path}/{name}").collect()
        assert len(rows) == docs_.count() and all(0 <= r.score <= 1 and r.held_out == away(r.doc_id) for r in rows)
        assert name != "none" or {r.score for r in rows} == {0.5}
        assert name != "one" or {r.score for r in rows} == {1.0}
