"""Near copies by the Jaccard similarity of five-word shingles, against all pairs."""

import random

import pytest

import corpus_pipeline as pipeline
from veilspan.llm import shingle_dedup as shingle

from .test_operators import classes


def brute_sets(texts):
    split = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


def brute_groups(texts):
    sets = brute_sets(texts)
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    return classes(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def near_copies(rng):
    texts = []
    for n in (7, 24, 60, 150, 400):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts += [" ".join(words), edited(rng, words, 1), edited(rng, words, max(1, n // 50)), edited(rng, words, n // 8)]
    hot = [f"h{k}" for k in range(120)]
    return texts + [edited(rng, hot, 2) for _ in range(60)]


@pytest.mark.parametrize("tile", [1 << 18, 1500])
def test_every_pair_of_similarity_is_found(spark, odd_rows, monkeypatch, tile):
    monkeypatch.setattr(shingle, "TILE", tile)
    texts = near_copies(random.Random(6)) + [r[1] for r in odd_rows]
    group = brute_groups(texts)
    assert len(set(group)) < len({frozenset(s) for s in brute_sets(texts)}) - 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in shingle.shingle_dedup(docs).collect()) == sorted(set(group))


def test_pipeline_stage_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (1, 177, 6, 145)")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert len(set(brute_groups(texts))) == 2 and pipeline.near_copies(spark, docs, sf).count() == 2


def test_odd_rows_keep_one_of_each_group(spark, odd, odd_rows, empty):
    kept = shingle.shingle_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(brute_groups([r[1] for r in odd_rows])))
    assert shingle.shingle_dedup(empty).count() == 0
