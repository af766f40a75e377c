"""Findings that are surrogates already: the project's mapping is met once, for exact and for other case."""

from veilspan.operators import modes
from veilspan.schema import FINDINGS, STATE_SCHEMAS
from veilspan.sources.state import State


def test_known_surrogates_are_met_in_one_join(spark, monkeypatch):
    calls, real = [], modes.lookup
    monkeypatch.setattr(modes, "lookup", lambda *a, **k: calls.append(1) or real(*a, **k))
    mappings = spark.createDataFrame([("p", t, f"o{i}", s, 1, None, None) for i, (t, s) in enumerate((
        ("EMAIL", "Ab@x.test"), ("SECRET", "Key1"), ("SECRET", "KEY1"), ("CUSTOM", None), ("IPV4", "10.0.0.9")))], STATE_SCHEMAS["mappings"])
    none = State.empty(spark)
    state = State(mappings, none.token_map, none.networks, none.placeholders)
    span = lambda typ, text: (0, len(text), typ, text, "d", 1, {})
    spans = [span("EMAIL", "aB@X.test"), span("SECRET", "Key1"), span("SECRET", "key1"), span("IPV4", "10.0.0.9"), span("EMAIL", "c@x.test")]
    found = spark.createDataFrame([(1, spans), (2, []), (2, spans[1:3]), (None, spans[3:])], f"doc_id int, spans {FINDINGS}")
    got = sorted((str(r.doc_id), [s.text for s in r.spans]) for r in modes.skip_known(found, state, "p").collect())
    assert got == [("1", ["key1", "10.0.0.9", "c@x.test"]), ("2", []), ("2", ["key1"]), ("None", ["10.0.0.9", "c@x.test"])]
    assert len(calls) == 1
