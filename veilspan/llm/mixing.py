"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of the source.
The whole part is certain; the fractional parts are rounded dependently: two units exchange
words-mass at random, in fair proportion, until one of them holds 0 or 1, and the other goes on to
meet the next. So the expected copies of each document are kept, and the words that a source gives
differ from its target by less than one document.

The pairing runs in groups of a bounded number of rows of one source; each group leaves one unit
that is still open. Those meet in groups again: a reduction tree, so neither a hot source nor the
number of sources matters to one task.

Null texts and texts without words have size 0 and are rounded alone. Null sources are one source,
last in order. Rows equal in id, source and text are one unit and share its copies. An empty table,
or one without words, gives targets of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilspan.functions.tables import lookup
from veilspan.llm.common import WORD, sheltered, stored

GROUP_ROWS = 1024
FAN_IN = 512
SEED = 20240611
UNIT = ("key", "doc_id", "text_key", "rows", "size", "p")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (key, source, source_size, rows: one row per source) + target.

    ``share`` of all words is divided by weight; no source gets over ``most`` times its size, what is
    over goes to the others by weight, until none is above. The level is found from sums over the
    sources; each round caps at least one more source, and only the sums come to the driver."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = stored(sizes.withColumn("weight", cycle), "weighed")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("source_size")
        capped, free = weighed.agg(
            F.sum(F.when(over, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        if not free:
            break
        next_level = (total - capped) / free
        if next_level <= level:
            break
        level = next_level
    return weighed.withColumn("target", F.least(F.lit(level) * F.col("weight"), most * F.col("source_size")).cast("double"))


def _pair(p: np.ndarray, w: np.ndarray, draw: np.ndarray) -> int:
    """Round p in place, in order (large units first, so that small ones settle what is left open); the
    index of the unit that stays open, or -1."""
    held = -1
    for j in range(len(p)):
        if not w[j]:
            p[j] = 1.0 if draw[j] < p[j] else 0.0
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * w[i], p[j] * w[j])
        down = min(p[i] * w[i], (1 - p[j]) * w[j])
        moved = up if draw[j] * (up + down) < down else -down
        p[i] += moved / w[i]
        p[j] -= moved / w[j]
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
        open_ = [k for k in (i, j) if 0 < p[k] < 1]
        held = open_[0] if open_ else -1
    return held


def _round_group(last: bool, level: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("text_key", "ascending")])
        p = group.column("p").to_numpy().copy()
        w = (group.column("size").to_numpy() * 1.0)
        seed = [SEED, level, *(group.column("text_key").to_numpy()[:4].astype(np.uint64).tolist()), len(p)]
        draw = np.random.Generator(np.random.PCG64(seed)).random(len(p) + 1)
        held = _pair(p, w, draw)
        if last and held >= 0:
            p[held] = 1.0 if draw[-1] < p[held] else 0.0
        return group.set_column(group.column_names.index("p"), "p", pa.array(p))

    return run


def pivotal(units: DataFrame, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """units (key, doc_id, text_key, rows, size, p, n_units: units of the key) with p rounded to 0 or 1."""
    schema = units.select(*UNIT, F.lit(0).cast("bigint").alias("groups"), F.lit(0).cast("bigint").alias("bucket")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    groups = F.ceil(F.col("n_units") / group_rows).cast("bigint")
    rest = units.withColumn("groups", groups).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(SEED)), F.col("groups")))
    rest = rest.select(*schema.names)
    most = units.agg(F.max(groups)).first()[0] or 1
    done, level = [], 0
    while True:
        rounded = stored(rest.groupBy("key", "bucket").applyInArrow(_round_group(most <= 1, level), schema), "rounded")
        done.append(rounded.where((F.col("p") == 0) | (F.col("p") == 1)))
        if most <= 1:
            break
        rest = rounded.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        most, level = -(-most // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*UNIT)


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per unit of docs: doc_id, text_key, source, size, rows, source_size, target, copies (of
    the unit, all its equal rows together). ``text_key`` is xxhash64 of source and text."""
    read = docs.select("doc_id", "source", F.xxhash64("source", "text").alias("text_key"), word_count(F.col("text")).alias("size"))
    sized = stored(read.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))), "mix-units")
    sources = sized.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    goal = stored(targets(sources, weights, share, most).drop("weight", "source"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = lookup(sized, goal, ["key"], F.col("doc_id"), "inner", 10_000).withColumn("_x", rate * F.col("rows"))
    fraction = F.col("_x") - F.floor("_x")
    units = wanted.withColumn("p", F.when(fraction > 1 - 1e-9, F.lit(1.0)).when(fraction < 1e-9, F.lit(0.0)).otherwise(fraction))
    rounded = lookup(pivotal(units), goal, ["key"], F.col("doc_id"), "inner", 10_000)
    source = F.when(F.col("key") == "null", F.lit(None).cast("string")).otherwise(F.substring("key", 2, 1 << 30))
    return rounded.withColumn("_x", rate * F.col("rows")).select(
        "doc_id", "text_key", source.alias("source"), "size", "rows", "source_size", "target",
        (F.floor("_x") + F.col("p")).cast("bigint").alias("copies"))


def copies_per_row(plan: DataFrame) -> DataFrame:
    """A unit of several equal rows again as one row each; the copies are dealt out as evenly as can be."""
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("_k") <= F.pmod("copies", "rows"), 1).otherwise(0)
    return plan.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))).withColumn(
        "copies", each.cast("bigint")).drop("_k", "rows")


@sheltered("doc_id", "source", "text")
def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as it is taken. One shuffle of the texts of
    taken units; equal rows of one id and text need one more aggregation, only if there are any."""
    plan = stored(plan_copies(docs, weights, share, most).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_t"), "copies", "rows"), "mix-plan")
    keyed = docs.withColumn("_t", F.xxhash64("source", "text")).join(plan.withColumnsRenamed({"copies": "_copies", "rows": "_rows", "_t": "_u"}),
                                                                     F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")))
    out = keyed.where("_rows = 1")
    if not plan.where("rows > 1").isEmpty():
        rest = [c for c in docs.columns if c != "doc_id"]
        equal = keyed.where("_rows > 1").groupBy("doc_id", "_t", "_copies").agg(*[F.first(c).alias(c) for c in rest])
        out = out.select(*docs.columns, "_copies").unionByName(equal.select(*docs.columns, "_copies"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*docs.columns)
