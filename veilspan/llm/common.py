"""What the training-data operators share: the shared folder, stored tables, words, long texts in batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run without ASCII white space; Python's bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without the setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: computed once, short lineage, and still
    there when an executor is lost. Spark's committer keeps the files of one attempt per task."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sheltered(*used: str) -> Callable:
    """For an operator docs -> docs with the same columns: those it does not use travel under names of
    their own, told apart by place, so no input column clashes with a name inside or is changed."""
    def around(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = docs.columns
            own = [n if n in used and n not in names[:k] else f"_carried_{k}" for k, n in enumerate(names)]
            return operator(docs.toDF(*own), *args, **kwargs).select(*own).toDF(*names)

        return run

    return around


def free_name(df: DataFrame, name: str) -> str:
    """The name, or if a column has it, the name with the first free number behind."""
    taken, k, out = {c.lower() for c in df.columns}, 1, name
    while out.lower() in taken:
        k, out = k + 1, f"{name}_{k + 1}"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, at_once: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as UTF-8, in slices of about ``at_once`` bytes: (first row, texts). A text
    is never cut; null counts as empty."""
    texts = batch.column(column).cast(pa.binary())
    first, held, size = 0, [], 0
    for text in texts:
        value = text.as_py() or b""
        held.append(value)
        size += len(value)
        if size >= at_once:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held
