"""Job entry: texts in, texts out.

    spark-submit -m veilspan.job analyze --input docs.parquet --output findings.json
    spark-submit -m veilspan.job redact --input docs.parquet --output clean.parquet
    spark-submit -m veilspan.job pseudonymize --input … --output … --state state --project p --key-env KEY
    spark-submit -m veilspan.job revert --input … --output … --state state --project p --key-env KEY

Input and output are Parquet, JSON (a row per line) or text (a row per line, ids from the content), by
the end of the path; a table needs the columns doc_id and text. The key comes from the environment, so it
is in no command line.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.lists import Context
from veilspan.operators.detect import explode_spans, find_spans
from veilspan.operators.modes import anonymize, pseudonymize, redact, revert
from veilspan.sources.state import State

MODES = ("analyze", "redact", "anonymize", "pseudonymize", "revert")


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema("doc_id bigint, text string").json(path)
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    if path.endswith((".json", ".jsonl")):
        df.write.json(path)
    elif path.endswith(".txt"):
        df.select("text").write.text(path)
    else:
        df.write.parquet(path)


def run(spark: SparkSession, mode: str, source: str, target: str, state_path: str | None = None, project: str = "default",
        key: str | None = None, types: list[str] | None = None, ctx: Context | None = None) -> None:
    """One job. ``pseudonymize`` extends the state, ``revert`` reads it; the others have none."""
    docs = read(spark, source)
    if mode in ("pseudonymize", "revert") and not (state_path and key):
        raise ValueError(f"{mode} needs a state and a key")
    if mode == "analyze":
        write(explode_spans(find_spans(docs, ctx=ctx), "doc_id").select("doc_id", "start", "end", "type", "text", "detector"), target)
        return
    if mode == "redact":
        done = redact(docs, ctx=ctx, types=types)
    elif mode == "anonymize":
        done = anonymize(docs, ctx=ctx)
    elif mode == "pseudonymize":
        done, state = pseudonymize(docs, State.load(spark, state_path), project, key, ctx)
    else:
        done = revert(docs, State.load(spark, state_path), project, key, ctx)
    write(done.select("doc_id", F.col("output").alias("text")), target)
    if mode == "pseudonymize":
        state.save(state_path)


def main(arguments: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="veilspan.job")
    parser.add_argument("mode", choices=MODES)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--state")
    parser.add_argument("--project", default="default")
    parser.add_argument("--key-env", default="VEILSPAN_KEY")
    parser.add_argument("--types", nargs="*")
    a = parser.parse_args(arguments)
    run(SparkSession.builder.appName("veilspan").getOrCreate(), a.mode, a.input, a.output, a.state, a.project, os.environ.get(a.key_env), a.types)


if __name__ == "__main__":
    main(sys.argv[1:])
