"""Periodic runs against a plain search of every period, through the function and the registered query."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from veilspan.llm.periodic_runs import LEAST, Grammar, periodic_runs, runs_of
from veilspan.llm.queries import QUERIES


def brute_runs(words, least=LEAST, times=3):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            smaller = lambda q: all(words[k] == words[k + q] for k in range(i, i + length - q))  # noqa: B023, E731
            if j > i and length >= max(least, times * p) and not any(map(smaller, range(1, p))):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """What the contract of the query says about a document."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def repeating(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 9, 20]))]
        words += unit * rng.choice([1, 2, 4, 8, 13]) + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
    return words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (1, 2)])
def test_runs_of_many_texts_at_once(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = [[w.encode() for w in repeating(rng)] for _ in range(rng.randint(1, 6))]
        got = [[] for _ in texts]
        for text, *run in zip(*(c.tolist() for c in runs_of(texts, least, times))):
            got[text].append(tuple(run))
        assert got == [brute_runs(t, least, times) for t in texts]


def test_grammar_answers_how_far_places_agree():
    rng = np.random.default_rng(3)
    for size in (5, 40, 700):
        body = np.repeat(rng.integers(1, 4, size), rng.integers(1, 6, size))
        s = np.concatenate([[0], body, body[:size], [9]])
        a, b = np.triu_indices(len(s), 1)
        pick = rng.choice(len(a), min(len(a), 4000), replace=False)
        a, b = a[pick], b[pick]
        for step in (1, -1):
            want = []
            for x, y in zip(a.tolist(), b.tolist()):
                k = 0
                while 0 <= x + k * step and y + k * step < len(s) and s[x + k * step] == s[y + k * step]:
                    k += 1
                want.append(k)
            assert Grammar(s).agree(a, b, step).tolist() == want


def test_query_on_the_table(spark, sf):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_recompression_runs"][0](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: brute_row(r.doc_id, r.text) for r in docs} and sum(r[0] for r in got.values()) > 10


def test_query_on_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    run = QUERIES["op12_recompression_runs"][0]
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [(r[0], *brute_row(r[0], r[1])) for r in odd_rows]
    assert sorted(map(tuple, run(spark, f"{tmp_path}/odd").collect()), key=key) == sorted(want, key=key)
    assert run(spark, f"{tmp_path}/empty").count() == 0


def test_clashing_columns_do_not_matter(spark):
    text = "x " * 30 + "y"
    docs = spark.createDataFrame([(1, text, 5, "r")], "doc_id int, text string, n_words int, runs string")
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()] == [(1, 31, [(0, 30, 1)], "x y")]


def test_planted_tails_of_short_texts(spark, tmp_path):
    """Documents whose checksum plants a tail, with no word, few words, blanks only, and no text."""
    chosen = [i for i in range(-200, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    texts = [None, "", " ", "\t\n", "a", "a b", " a\x0bb  c ", "é ü", "x " * 40, "y z " * 300]
    rows = [(i, texts[k % len(texts)]) for k, i in enumerate(chosen)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_recompression_runs"][0](spark, str(tmp_path)).collect()}
    assert got == {i: brute_row(i, t) for i, t in rows}
