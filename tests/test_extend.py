"""What users add: functions in SQL, own detectors that fail, own surrogates."""

import re

from pyspark.sql import functions as F

from veilspan import sql
from veilspan.functions.regex import attempt
from veilspan.functions.text import keyed_hash
from veilspan.lists import Context
from veilspan.operators import detectors as registry
from veilspan.operators.detect import find_spans
from veilspan.operators.detectors import python_detector
from veilspan.operators.modes import pseudonymize, revert
from veilspan.sources.state import State

TEXTS = [(1, "mail a.b@zeta-test.de and it's \\ 10.1.2.3"), (2, ""), (3, None), (4, "nothing")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_expressions_as_sql(spark):
    x = F.col("x")
    for column in ((x + 2) * -x / 3 % 5, (x > 1) & ~(x == 3) | (x <= 0), F.when(x.isin(1, 2), F.lit("it's \\ a (-) \n")).otherwise(F.lit("and(")),
                   F.transform(F.array(x, x - 1), lambda v: F.struct(v.alias("end"), (v >= 1).alias("c")))):
        rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, None)], "x int").select(column.alias("a"), F.expr(sql.column_sql(column)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_functions_in_sql(spark):
    ctx = Context(redact_template="<{type}>")
    assert sql.register_functions(spark, ctx, detectors=("email", "ipv4"), prefix="t_") == ["t_find_spans", "t_redact_text", "t_clean_url"]
    docs(spark).createOrReplaceTempView("sql_texts")
    found = spark.sql("select d.doc_id, s.start, s.type, s.text from sql_texts d, lateral t_find_spans(d.text) s")
    assert sorted(map(tuple, found.collect())) == [(1, 5, "EMAIL", "a.b@zeta-test.de"), (1, 33, "IPV4", "10.1.2.3")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    row = spark.sql("select t_redact_text('to a.b@zeta-test.de!') r, t_clean_url('https://x.org/?utm_source=a&b=1') u, t_redact_text(null) n").first()
    assert tuple(row) == ("to <EMAIL>!", "https://x.org/?b=1", None)


def test_a_row_that_throws_is_null(spark):
    value = F.transform(F.array("x"), lambda v: F.when(v == 2, F.raise_error(F.lit("two")).cast("int")).otherwise(v))
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (None,)], "x int").select(attempt(value)).collect()] == [[1], None, [None]]


def test_python_detector_that_fails(spark):
    def find(text):
        if "@" in text:
            raise ValueError
        return [(0, 99, "CUSTOM")] if text == "" else [(0, 3, "CUSTOM")]

    registry.register(python_detector("own", ("CUSTOM",), 99, find))
    try:
        rows = {r.doc_id: r for r in find_spans(docs(spark), ("email", "own")).collect()}
    finally:
        registry.unregister("own")
    failed = ["detector own failed, skipped"]
    assert [s.type for s in rows[1].spans] == ["EMAIL"] and rows[1].warnings == failed  # it threw
    assert rows[2].spans == [] and rows[2].warnings == failed  # its finding lies outside the text
    assert rows[3].spans == [] and rows[3].warnings == [] and [(s.text, s.detector) for s in rows[4].spans] == [("not", "own")]


def test_bad_pattern_is_a_warning(spark):
    ctx = Context(custom_terms=({"term": "(x", "regex": True}, {"term": "nothing"}))
    rows = {r.doc_id: r for r in find_spans(docs(spark), ("custom",), ctx=ctx).collect()}
    assert [s.text for s in rows[4].spans] == ["nothing"] and rows[4].warnings == ["term is no valid pattern, skipped: (x"]


def test_own_surrogates_stay_unique(spark):
    """Ten values for forty originals: the others get a longer value; a generator may pass with NULL."""
    def digit(original, key, attempt_):
        value = F.concat(F.lit("Q"), F.substring(F.translate(keyed_hash(key, original, F.lit(attempt_)), "abcdef", "012345"), 1, 1))
        return F.when(F.lit(attempt_ > 0), value)

    registry.register(python_detector("codes", ("CODE",), 90, lambda t: [(m.start(), m.end(), "CODE") for m in re.finditer(r"C\d+", t)]))
    rows = [(k, f"code C{k % 40} here") for k in range(60)]
    try:
        out, state = pseudonymize(docs(spark, rows), State.empty(spark), "p", "key", Context(generators={"CODE": digit}), detectors=("codes",))
    finally:
        registry.unregister("codes")
    given = {r.original: r.surrogate for r in state.mappings.collect()}
    assert len(given) == len(set(given.values())) == 40 and all(re.fullmatch(r"Q\d(-[0-9a-f]+)?", v) for v in given.values())
    assert sum(bool(re.fullmatch(r"Q\d", v)) for v in given.values()) >= 5
    back = revert(out.selectExpr("doc_id", "output as text"), state, "p", "key")
    assert {r.doc_id: r.output for r in back.collect()} == dict(rows)
