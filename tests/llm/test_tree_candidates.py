"""The pipeline's near-dedup searches by vantage-point trees over SimHashes, not by MinHash bands only."""

import random

import corpus_pipeline as pipeline
from veilspan.llm import shingle_dedup as shingle

from .test_operators import classes


def test_trees_link_sets_up_to_two_bits_apart(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(63) for _ in range(300)]
    prints += [p ^ 5 for p in prints[:40]] + [p ^ 7 for p in prints[40:80]] + prints[80:90]
    kinds = spark.createDataFrame([(k, 1, p) for k, p in enumerate(prints)], "fp bigint, n bigint, sim bigint")
    got = classes(len(prints), [(r.a, r.b) for r in shingle.tree_links(kinds).collect()])
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert got == classes(len(prints), near) and len(set(got)) == len(prints) - 50


def test_near_copies_are_found_by_trees_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(shingle, "band_links", lambda kinds: kinds.selectExpr("fp as a", "fp as b").limit(0))
    rng = random.Random(4)
    long = [[f"w{rng.randrange(9000)}" for _ in range(20_000)] for _ in range(6)]
    texts = [" ".join(t) for t in long] + [" ".join([*t[:-1], "other"]) for t in long]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert pipeline.near_copies(spark, docs, sf).count() < len(texts)
