"""Phrases by both ways against a plain search."""

import random
import re

import pytest

from veilspan.operators.phrases import PhraseAutomaton, leftmost_longest, with_phrases

CHAR = "A-Za-z0-9_À-ɏ"


def brute(text, terms, longest):
    found = set()
    for term, ci in terms:
        if re.search(f"[{CHAR}]", term):
            for start in range(len(text or "")):
                piece = text[start:start + len(term)]
                edges = (start == 0 or not re.match(f"[{CHAR}]", text[start - 1])) and not re.match(f"[{CHAR}]", text[start + len(term):start + len(term) + 1])
                if edges and (piece == term or ci and piece.lower() == term.lower()):
                    found.add((start, start + len(term), piece, term))
    if not longest:
        return sorted(found)
    kept, free = [], 0
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[3])):
        if f[0] >= free:
            kept.append(f)
            free = f[1]
    return kept


TERMS = [("a b", False), ("a b a", False), ("b a", True), ("b", False), ("a  b", False), ("(b) c", False), ("c é", True), ("New York", True),
         ("New York City", False), ("York", False), ("...", False), ("", False), ("a b a b a b", False), ("x-y z.", False)]


def texts():
    rng = random.Random(3)
    parts = ["a", "b", "B", "c", "É", "é", "New", "new", "York", "YORK", "City", "x-y", "z.", "(b)", "ab", "...", "_a"]
    made = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", ", ", "\n", ""]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    return [*made, None, "", " ", "a b " * 400, "New York City New York", "anew york", "a b a b a b a"]


@pytest.mark.parametrize("longest", [True, False])
@pytest.mark.parametrize("how", [{}, {"automaton_bytes": 0}, {"automaton_bytes": 0, "broadcast_limit": 0}])
def test_both_ways_find_the_same(spark, longest, how):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string").repartition(3)
    terms = spark.createDataFrame([(t, ci, {"k": t}) for t, ci in TERMS], "term string, ci boolean, payload map<string,string>")
    got = {r.doc_id: [(o.start, o.end, o.text, o.term) for o in r.occurrences] for r in with_phrases(docs, terms, longest=longest, **how).collect()}
    want = {k: brute(t, TERMS, longest) for k, t in enumerate(texts())}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_payload_and_no_terms(spark):
    docs = spark.createDataFrame([(1, "see New York")], "doc_id int, text string")
    terms = spark.createDataFrame([("new york", True, {"k": "v"})], "term string, ci boolean, payload map<string,string>")
    assert [o.payload for o in with_phrases(docs, terms).first().occurrences] == [{"k": "v"}]
    assert with_phrases(docs, terms.limit(0)).first().occurrences == []


def test_automaton_reads_a_text_once():
    """A term that repeats one word and a text of that word: work grows with text and hits, not their product."""
    automaton = PhraseAutomaton([("a " * 400 + "b", False, None), ("a a", False, None)])
    steps = []
    automaton.go = [type("Counted", (dict,), {"get": lambda self, *k: steps.append(1) or dict.get(self, *k)})(g) for g in automaton.go]
    assert len(automaton.find("a " * 5000)) == 4999 and len(steps) <= 5000


def test_leftmost_longest():
    assert leftmost_longest([(0, 3), (0, 5), (4, 9), (5, 6), (6, 9)]) == [1, 3, 4] and leftmost_longest([]) == []
