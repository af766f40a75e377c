"""Layout tables: boxes of characters, words and detections in, boxes to cover out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.regex import empty, let
from veilspan.functions.tables import cut



# ---------------------------------------------------------------- box arithmetic
def pct(value: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(200), value.try_cast("int"))), F.lit(0))


def pad_box(x: Column, y: Column, w: Column, h: Column, pad: Column, width: Column, height: Column) -> Column:
    """STRUCT<x, y, w, h> grown on every side, cut at the picture (a size of 0 means unknown)."""
    x0, y0 = F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0))
    x1 = F.when(width > 0, F.least(width, x + w + pad)).otherwise(x + w + pad)
    y1 = F.when(height > 0, F.least(height, y + h + pad)).otherwise(y + h + pad)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(1), x1 - x0).alias("w"), F.greatest(F.lit(1), y1 - y0).alias("h"))


def add_margin(boxes: DataFrame, percent: int, min_pad: int, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes grown by ``percent`` of their larger side, at least ``min_pad``, clamped to the picture."""
    share = pct(F.lit(percent)) / 100 * F.greatest("w", "h")
    pad = F.greatest(F.lit(min_pad), F.bround(share).cast("int"))
    new = pad_box(*[F.col(c) for c in "xywh"], pad, F.col(width), F.col(height))
    return boxes.withColumn("_b", new).select(*[c for c in boxes.columns if c not in "xywh"], "_b.x", "_b.y", "_b.w", "_b.h")


def iou(a: Column, b: Column) -> Column:
    iw = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - iw * ih
    return F.coalesce(F.try_divide(iw * ih, union), F.lit(0.0))


def touching(a: Column, b: Column) -> Column:
    return ~((b["x"] > a["x"] + a["w"]) | (a["x"] > b["x"] + b["w"]) | (b["y"] > a["y"] + a["h"]) | (a["y"] > b["y"] + b["h"]))


def scale_boxes(boxes: DataFrame, pixel_w: str, pixel_h: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Pixel boxes to the coordinates of the area they were found in."""
    sx = (F.col(x1) - F.col(x0)) / F.greatest(F.lit(1), F.col(pixel_w))
    sy = (F.col(y1) - F.col(y0)) / F.greatest(F.lit(1), F.col(pixel_h))
    return boxes.withColumn("bx0", F.col(x0) + F.col("x") * sx).withColumn("by0", F.col(y0) + F.col("y") * sy).withColumn(
        "bx1", F.col(x0) + (F.col("x") + F.col("w")) * sx).withColumn("by1", F.col(y0) + (F.col("y") + F.col("h")) * sy)


# ---------------------------------------------------------------- joins
def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lspan: tuple, rspan: tuple, width: int = 256) -> DataFrame:
    """Pairs whose half-open ranges overlap. Both sides are cut into blocks of ``width`` positions and
    meet by equality on (keys, block), so a long document spreads over many tasks; a pair counts
    in the first block both have."""
    def blocks(df: DataFrame, span: tuple) -> DataFrame:
        first, last = F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width)
        return df.where(F.col(span[1]) > F.col(span[0])).withColumn("_blk", F.explode(F.sequence(first, last)))

    joined = blocks(left, lspan).join(blocks(right, rspan), [*keys, "_blk"])
    common = F.floor(F.greatest(F.col(lspan[0]), F.col(rspan[0])) / width)
    return joined.where((F.col(lspan[0]) < F.col(rspan[1])) & (F.col(rspan[0]) < F.col(lspan[1])) & (
        F.col("_blk") == common)).drop("_blk")


def text_boxes(spans: DataFrame, chars: DataFrame, pad: float = 0.6) -> DataFrame:
    """One padded box per (span, page, line); ``first`` marks the box that gets the label.

    spans(doc_id, start, end, type, text), chars(doc_id, pos, page, line, x0, y0, x1, y1).
    """
    located = chars.withColumn("_p1", F.col("pos") + 1)
    hit = overlap_join(spans, located, ["doc_id"], ("start", "end"), ("pos", "_p1"))
    grouped = hit.groupBy("doc_id", "start", "end", "type", "text", "page", "line").agg(
        (F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"),
        (F.max("y1") + pad).alias("y1"), F.min("pos").alias("_pos"))
    order = Window.partitionBy("doc_id", "start", "end", "type").orderBy("_pos")  # the lines of one span
    first = F.row_number().over(order) == 1
    return grouped.withColumn("first", first).withColumn("label", F.when(first, F.col("text")).otherwise("")).drop("_pos", "text")


def box_replacements(boxes: DataFrame, reps: DataFrame) -> DataFrame:
    """The replacement is written in the first box of a span, the others stay empty."""
    small = reps.select("doc_id", F.col("in_start").alias("start"), F.col("in_end").alias("end"), "replacement")
    return boxes.join(small, ["doc_id", "start", "end"], "left").withColumn(
        "replacement", F.when(F.col("first"), F.coalesce("replacement", F.lit(""))).otherwise(""))


def document_text(chars: DataFrame) -> DataFrame:
    """(doc_id, text) from characters in reading order: a line break per line, one more per page.
    A document is one row, as everywhere; its lines are built first."""
    lines = chars.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "ch"))), lambda c: c["ch"]), "").alias("t"))
    pages = lines.groupBy("doc_id", "page").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("line", "t"))), lambda x: F.concat(x["t"], F.lit("\n"))), ""), F.lit("\n")).alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("page", "t"))), lambda x: x["t"]), "").alias("text"))


def char_positions(chars: DataFrame) -> DataFrame:
    """Position of every character in the text of ``document_text``: its rank plus the line breaks before
    it. Ranks run inside a line; lengths of lines and pages are summed on their own small tables."""
    line_len = chars.groupBy("doc_id", "page", "line").agg((F.count("*") + 1).alias("n"))
    lines = line_len.withColumn("_off", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id", "page").orderBy("line").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)))
    page_len = line_len.groupBy("doc_id", "page").agg((F.sum("n") + 1).alias("n"))
    pages = page_len.withColumn("_page", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("doc_id", "page", "line").orderBy("pos")) - 1
    return chars.withColumn("_r", rank).join(lines.drop("n"), ["doc_id", "page", "line"]).join(pages, ["doc_id", "page"]).withColumn(
        "pos", (F.col("_page") + F.col("_off") + F.col("_r")).cast("int")).drop("_r", "_off", "_page")


def word_lines(words: DataFrame) -> DataFrame:
    """(image_id, line, text, words with offsets): blanks come back from the gaps between word boxes.

    A gap over 0.45 of the (upper) median character width is 1 to 4 blanks.
    """
    by_line = Window.partitionBy("image_id", "line")
    used = words.where(F.length("text") > 0)
    share = F.col("w") / F.greatest(F.length("text"), F.lit(1))
    # the median by its rank: an array per word of all words of its line would grow with the square of a line
    ranked = used.withColumn("_cw", share).withColumn("_k", F.row_number().over(by_line.orderBy(F.asc_nulls_last("_cw")))).withColumn(
        "_n", F.count("_cw").over(by_line))
    sized = ranked.withColumn("_cw", F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("_cw"))).over(by_line)).drop("_k", "_n")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by_line.orderBy("x"))
    blanks = F.when(gap > 0.45 * F.col("_cw"), F.greatest(F.lit(1), F.least(F.lit(4), F.bround(gap / F.col("_cw")).cast("int")))).otherwise(0)
    spaced = sized.withColumn("_gap", F.coalesce(blanks, F.lit(0)))
    end = F.sum(F.col("_gap") + F.length("text")).over(by_line.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return spaced.withColumn("e", end.cast("int")).withColumn("s", (F.col("e") - F.length("text")).cast("int")).drop("_cw")


def line_texts(spaced: DataFrame) -> DataFrame:
    return spaced.groupBy("image_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_gap", "text"))),
                                                  lambda t: F.concat(F.repeat(F.lit(" "), t["_gap"]), t["text"])), "").alias("text"))


def ocr_boxes(spans: DataFrame, lines: DataFrame, words: DataFrame, skip_types: tuple = ()) -> DataFrame:
    """Boxes of spans over recognised lines, but not for spans of ``skip_types``. Words that are partly
    covered are covered whole; without word boxes the line box is cut in proportion.

    spans(image_id, start, end, type) in the lines joined by line breaks; lines(image_id, line, text,
    x, y, w, h, start); words(image_id, line, s, e, x, y, w, h).
    """
    if skip_types:
        spans = spans.where(~F.col("type").isin(*skip_types))
    located = lines.withColumn("_end", F.col("start") + F.length("text")).withColumnRenamed("start", "_start")
    hit = overlap_join(spans, located, ["image_id"], ("start", "end"), ("_start", "_end")).withColumn(
        "s0", F.greatest(F.col("start") - F.col("_start"), F.lit(0))).withColumn(
        "e0", F.least("end", "_end") - F.col("_start"))
    box = F.struct(*[F.col(c) for c in ("s", "e", "x", "y", "w", "h")])
    per_line = words.groupBy("image_id", "line").agg(F.collect_list(box).alias("_words"))  # the words of one line
    joined = hit.join(per_line, ["image_id", "line"], "left")
    covered = F.filter(F.coalesce("_words", F.array().cast(per_line.schema["_words"].dataType)), lambda v: (v["s"] < F.col("e0")) & (v["e"] > F.col("s0")))
    n = F.greatest(F.length("text"), F.lit(1))

    def build(ws: Column) -> Column:
        x0, y0 = F.array_min(F.transform(ws, lambda v: v["x"])), F.array_min(F.transform(ws, lambda v: v["y"]))
        x1 = F.array_max(F.transform(ws, lambda v: v["x"] + v["w"]))
        y1 = F.array_max(F.transform(ws, lambda v: v["y"] + v["h"]))
        top = F.least(y0, F.col("y"))
        exact = F.struct(x0.cast("int").alias("x"), top.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"),
                         (F.greatest(y1, F.col("y") + F.col("h")) - top).cast("int").alias("h"))
        left = F.col("x") + F.col("w") * F.col("s0") / n
        right = F.col("x") + F.col("w") * F.col("e0") / n
        slice_ = F.struct(F.floor(left).cast("int").alias("x"), F.col("y").cast("int").alias("y"),
                          F.greatest(F.lit(1), F.bround(right - left).cast("int")).alias("w"), F.col("h").cast("int").alias("h"))
        return F.when(F.size(ws) > 0, exact).otherwise(slice_)

    label = F.substring("text", F.col("s0") + 1, F.col("e0") - F.col("s0"))
    out = joined.withColumn("_b", let(covered, build))
    return out.select("image_id", "line", F.col("type").alias("kind"), label.alias("label"), "_b.x", "_b.y", "_b.w", "_b.h")


# ---------------------------------------------------------------- merging inside a picture
def _islands(boxes: DataFrame, group: list[str], band: int = 64) -> DataFrame:
    """Add ``_isl``: boxes of different islands are separated by empty rows of the picture, so nothing in
    one can touch anything in the other. Islands come from the distinct bands that are covered (at
    most height / band rows per picture), not from the boxes."""
    first, last = F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("h")) / band)
    bands = boxes.select(*group, F.explode(F.sequence(first, last)).alias("_band")).distinct()
    w = Window.partitionBy(*group).orderBy("_band")
    starts = bands.withColumn("_new", F.when(F.col("_band") - F.lag("_band").over(w) <= 1, 0).otherwise(1))
    named = starts.withColumn("_isl", F.sum("_new").over(w)).drop("_new")
    named = named.select("_isl", F.col("_band").alias("_b"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)))
    same = F.col("_band") == F.col("_b")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return boxes.withColumn("_band", first).join(named, same).drop("_band", "_b", *(f"_g{k}" for k in range(len(group))))


# Groups of fewer boxes are not cut into islands; up to so few boxes a plain search is faster than a grid.
CROWDED, FEW = 20_000, 16


def _parted(boxes: DataFrame, group: list[str]) -> DataFrame:
    """Add ``_isl``: islands in pictures that may have many boxes, one for all in the others. Boxes are counted
    per hash of their group, so what is counted stays small before it is shuffled."""
    bucket = F.pmod(F.xxhash64(*group), F.lit(1 << 20)).alias("_bucket")
    placed = boxes.where(F.col("y").isNotNull() & F.col("h").isNotNull())
    crowded = cut(placed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("_bucket"))
    if crowded.isEmpty():
        return placed.withColumn("_isl", F.lit(0).cast("bigint"))
    marked = placed.withColumn("_bucket", bucket)
    apart = _islands(marked.join(F.broadcast(crowded), "_bucket", "left_semi").drop("_bucket"), group)
    whole = marked.join(F.broadcast(crowded), "_bucket", "left_anti").drop("_bucket")
    return whole.withColumn("_isl", F.lit(0).cast("bigint")).unionByName(apart.withColumn("_isl", F.col("_isl").cast("bigint")))


class Grid:
    """Places of boxes (x, y, w, h, ...) by the cells they cover, so a box only meets those around it.
    Boxes over many cells are kept apart and met by all."""

    WIDE = 64

    def __init__(self, boxes: list[tuple]):
        sides = sorted(max(b[2], b[3]) for b in boxes)
        self.side = max(sides[len(sides) // 2], 1e-6) if boxes else 1.0
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.wide: list[int] = []

    def _covered(self, box: tuple) -> list[tuple[int, int]] | None:
        x, y, w, h = box[:4]
        xs, ys = (range(math.floor(min(p, p + d) / self.side), math.floor(max(p, p + d) / self.side) + 1) for p, d in ((x, w), (y, h)))
        return None if len(xs) * len(ys) > self.WIDE else [(i, j) for i in xs for j in ys]

    def put(self, place: int, box: tuple) -> None:
        covered = self._covered(box)
        if covered is None:
            if place not in self.wide[-8:]:
                self.wide.append(place)
        else:
            for cell in covered:
                held = self.cells.setdefault(cell, [])
                if not held or held[-1] != place:
                    held.append(place)

    def around(self, box: tuple, count: int):
        """Places that may touch the box, ascending."""
        covered = self._covered(box)
        if covered is None:
            return range(count)
        return sorted({*self.wide, *(k for cell in covered for k in self.cells.get(cell, ()))})


def _touch(a: tuple, b: tuple) -> bool:
    return not (b[0] > a[0] + a[2] or a[0] > b[0] + b[2] or b[1] > a[1] + a[3] or a[1] > b[1] + b[3])


def _iou(a: tuple, b: tuple) -> float:
    both = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union else 0.0


def _grown(o: tuple, b: tuple) -> tuple:
    x, y = min(o[0], b[0]), min(o[1], b[1])
    label = f"{o[5]} {b[5]}".strip(" ") if b[5] and o[5] is not None and b[5] not in o[5] else o[5]
    return (x, y, max(o[0] + o[2], b[0] + b[2]) - x, max(o[1] + o[3], b[1] + b[3]) - y, o[4], label)


def _better(o: tuple, b: tuple) -> tuple:
    return b if b[4] is not None and o[4] is not None and b[4] > o[4] else o


def fold_boxes(boxes: list[tuple], same, join) -> list[tuple]:
    """Each box (x, y, w, h, score, label) in turn joins the first one so far that is the ``same``, or
    stands for itself."""
    kept: list[tuple] = []
    if len(boxes) <= FEW:
        for box in boxes:
            at = next((k for k, o in enumerate(kept) if same(o, box)), None)
            if at is None:
                kept.append(box)
            else:
                kept[at] = join(kept[at], box)
        return kept
    grid = Grid(boxes)
    for box in boxes:
        at = next((k for k in grid.around(box, len(kept)) if same(kept[k], box)), None)
        if at is None:
            at = len(kept)
            kept.append(box)
        else:
            joined = join(kept[at], box)
            if joined is kept[at]:
                continue
            kept[at] = joined
        grid.put(at, kept[at])
    return kept


def _sorted(rows: list[tuple]) -> list[tuple]:
    """Missing values come last."""
    try:
        return sorted(rows)
    except TypeError:
        return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def _fold(boxes: DataFrame, group: list[str], order: list[str], same, join) -> DataFrame:
    """Fold the boxes of every island (or picture of few boxes) in their order. An island stays in one task, as
    each box depends on those before it; time is near linear in its boxes."""
    kinds = dict(boxes.dtypes)
    fields = ("x", "y", "w", "h", "score", "label")
    rows = _parted(boxes.withColumn("score", F.col("score") if "score" in kinds else F.lit(0.0)).withColumn(
        "label", F.col("label") if "label" in kinds else F.lit("")), group)
    rows = rows.select(*group, "_isl", *(F.col(c).cast("double").alias(f"_o{k}") for k, c in enumerate(order)),
                       *(F.col(c).cast("double").alias(f"_{c}") for c in fields[:5]), F.col("label").cast("string").alias("_label"))

    keys, n = [*group, "_isl"], len(group) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Islands come one behind the other, so a small one costs no more than its rows."""
        held, rows_, types = None, [], None

        def folded(done: list[tuple]) -> pa.RecordBatch:
            out = [(key[:-1], box) for key, listed in done for box in fold_boxes([r[len(order):] for r in _sorted(listed)], same, join)]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k, _ in out], types[i]) for i in range(n - 1)),
                 *(pa.array([box[i] for _, box in out], pa.string() if c == "label" else pa.float64()) for i, c in enumerate(fields))], [*group, *fields])

        for batch in batches:
            types, done = [c.type for c in batch.columns], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != held:
                    if rows_:
                        done.append((held, rows_))
                    held, rows_ = row[:n], []
                rows_.append(row[n:])
            if done:
                yield folded(done)
        if rows_:
            yield folded([(held, rows_)])

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "x double, y double, w double, h double, score double, label string"])
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def merge_boxes(boxes: DataFrame, group=("image_id", "kind", "effect")) -> DataFrame:
    """Boxes of one kind and effect that touch become one, in reading order; labels are joined."""
    return _fold(boxes, list(group), ["y", "x"], _touch, _grown)


def best_boxes(boxes: DataFrame, threshold: float = 0.3, group=("image_id", "kind"), order: str = "ord") -> DataFrame:
    """Detections that overlap by more than ``threshold`` (0 or more) are one; the better score stays (in input order)."""
    return _fold(boxes, list(group), [order], lambda a, b: _iou(a, b) > threshold, _better)


def usable_images(images: DataFrame, min_area: float = 0.01, min_pixels: int = 48) -> DataFrame:
    """Pictures of a page that are large enough, each rectangle once: images(doc_id, page, page_w, page_h,
    x0, y0, x1, y1, width, height)."""
    cut = images.withColumn("x0", F.greatest(F.lit(0.0), "x0")).withColumn("y0", F.greatest(F.lit(0.0), "y0")).withColumn(
        "x1", F.least("x1", "page_w")).withColumn("y1", F.least("y1", "page_h")).where("x1 > x0 and y1 > y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(F.lit(1.0), F.col("page_w") * F.col("page_h"))
    once = cut.withColumn("_k", F.struct(*[F.round(c, 1) for c in ("x0", "y0", "x1", "y1")]))
    return once.where((area >= min_area) & (F.least("width", "height") >= min_pixels)).dropDuplicates(["doc_id", "page", "_k"]).drop("_k")


def totals(boxes: DataFrame) -> DataFrame:
    """Per document: spans, boxes, pages."""
    return boxes.groupBy("doc_id").agg(F.count_if("first").alias("spans"), F.count("*").alias("boxes"), F.countDistinct("page").alias("pages"))
