"""The package for SQL users: temporary functions made of built-in expressions.

    register_functions(spark)
    SELECT d.doc_id, s.* FROM documents d, LATERAL find_spans(d.text) s
    SELECT redact_text(text) FROM documents

The functions hold the same expressions as the DataFrame API, written as SQL, so Catalyst sees no opaque
function and nothing runs row by row in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.url import clean_url
from veilspan.lists import Context
from veilspan.operators.detect import chosen_spans
from veilspan.operators.spans import apply_spans

#: Passes of the analyzer, which resolves an expression a level per pass: the functions have more levels than its 100.
PASSES = 1_000
SPAN_ROW = "start INT, `end` INT, type STRING, text STRING, detector STRING, priority INT, meta MAP<STRING,STRING>"
# A string literal, or the name of an operator that is called like a function.
_OPERATOR = re.compile(r"'(?:[^'\\]|\\.|'')*'|(?<![\w`\]')])(<=>|<=|>=|==|!=|<>|[-+*/%=<>&|^~!]|and|or|not|in)\(", re.S)


def column_sql(column: Column) -> str:
    """The expression as SQL text. Operators in call form are quoted, as their names are no identifiers;
    names of struct fields have to be some."""
    return _OPERATOR.sub(lambda m: m.group(0) if m.group(1) is None else f"`{m.group(1)}`(", column._jc.node().sql())


@contextmanager
def _deep(spark: SparkSession) -> Iterator[None]:
    """Functions created here may be that deep. A function keeps the settings it was created under, so the
    session's own are put back."""
    name = "spark.sql.analyzer.maxIterations"
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, max(int(spark.conf.get(name)), PASSES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def register_functions(spark: SparkSession, ctx: Context | None = None, detectors=None, skip=(), prefix: str = "") -> list[str]:
    """Create or replace temporary functions of this session; returns their names.

    ``find_spans(text)`` is a table function with a row per span. ``redact_text(text)`` gives the text
    with the context's template (``{type}``: the type) for each span, ``clean_url(url)`` a URL without its tracking.
    Settings and registered detectors are those of now; register again after a change.
    """
    ctx = ctx or Context()
    text = F.col("text")
    spans = chosen_spans(text, ctx, detectors, skip)
    marks = F.transform(spans, lambda s: F.struct(*(s[f] for f in ("start", "end", "type", "text", "detector", "priority")), F.replace(
        F.lit(ctx.redact_template), F.lit("{type}"), s["type"]).alias("replacement")))
    functions = {
        f"{prefix}find_spans": (SPAN_ROW, f"SELECT inline({column_sql(spans)})"),
        f"{prefix}redact_text": (None, column_sql(apply_spans(text, marks)["output"])),
        f"{prefix}clean_url": (None, column_sql(clean_url(text, ctx.tracking_params)))}
    with _deep(spark):
        for name, (row, body) in functions.items():
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}(text STRING) RETURNS {f'TABLE({row})' if row else 'STRING'} RETURN {body}")
    return list(functions)
