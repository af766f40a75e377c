"""Benchmark decontamination: pigeonhole pieces, verified with Myers' bit-parallel edit distance.

Texts and test items are sequences of normalised words (lower case, only letters and digits kept); in
scripts without blanks each character is a word. A document contains an item if some stretch of it is at most ``budget`` word edits (insert, delete,
replace) away from the item; the budget is a fifth of the item's words, so at least four in five stay.
An item is cut into budget + 1 pieces: budget edits cannot touch them all, so one piece occurs
unchanged in each such stretch. Piece hits are looked up by hash in one pass over each text, and
around each hit the distance is computed exactly, with the columns of the edit matrix as bit vectors.

The items are a stated query set. They are read in blocks of bounded size, ``BLOCK_CHARS``; a block is
broadcast, indexed once per worker, and all documents pass by: a benchmark of n blocks costs n passes
over the texts. The documents are not shuffled.

Items under ``SHORT`` words are searched for exactly, as an edit in them is no sign of copying. Null texts
and texts without words contain nothing. Items without words cannot be searched for: ``usable_items`` says
which, ``contaminated`` has no rows for them. An empty benchmark or table has no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import free_name, text_slices

#: Words below which an item has to occur as it is, edits allowed per word, and characters of item texts in a block.
SHORT, EDITS, BLOCK_CHARS = 8, 0.2, 4 << 20
CACHED = 400_000
SLICE_BYTES = 1 << 19
HITS = "item_id bigint, distance int, item_words int, first_word int, last_word int"
_KEPT = re.compile(r"[^\W_]+")
#: Thai and Lao, Burmese, Khmer, kana, Han: scripts that set no blanks between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
_SEVERAL = 2  # no code of a word, as those are odd
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalized(word: str) -> list[str]:
    """The words that a piece between blanks stands for: one, none, or several without blanks."""
    plain = "".join(_KEPT.findall(word.lower()))
    return [plain] if plain.isascii() and plain else _WORDS.findall(plain)


class WordCodes:
    """64-bit codes of normalised words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.several: dict[bytes, list[int]] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known, self.several, new = {}, {}, set(words)
        for word in new:
            codes = [xxhash.xxh64_intdigest(w.encode(), 7) | 1 for w in normalized(word.decode())]
            self.known[word] = codes[0] if len(codes) == 1 else _SEVERAL if codes else 0
            if len(codes) > 1:
                self.several[word] = codes
        codes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if self.several and (codes == _SEVERAL).any():
            parts = (self.several.get(w) or [c] for w, c in zip(words, codes.tolist()))
            codes = np.fromiter((c for part in parts for c in part), np.uint64)
        return codes[codes != 0]


CODES = WordCodes()


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive codes."""
    n = len(codes) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(length if n > 0 else 0):
        out = out * _FACTOR + codes[i:i + n]
    return out ^ (out >> np.uint64(29))


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(smallest distance of the item to a stretch of the text, where that stretch ends): Myers."""
    peq: dict[int, int] = {}
    for i, word in enumerate(item):
        peq[word] = peq.get(word, 0) | (1 << i)
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    pv, mv, score, best = full, 0, len(item), (len(item), -1)
    for j, word in enumerate(text):
        eq = peq.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, j)
    return best


class Items:
    """A block of items and where their pieces begin."""

    def __init__(self, items: list[tuple[int, str]], edits: float, short: int):
        self.ids = [item_id for item_id, _ in items]  # ids may repeat or be null; inside, items go by place
        self.words: dict[int, list[int]] = {}
        self.budget: dict[int, int] = {}
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, (_, text) in enumerate(items):
            codes = CODES.of((text or "").encode().split())
            if not len(codes):
                continue
            budget = int(edits * len(codes)) if len(codes) >= short else 0
            self.words[item], self.budget[item] = codes.tolist(), budget
            cuts = [len(codes) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                piece = int(rolling(codes[a:b], b - a)[0])
                by_length.setdefault(b - a, {}).setdefault(piece, []).append((item, a))
        self.pieces = {}
        for length, pieces in by_length.items():
            seen = np.zeros(1 << 20, bool)
            seen[np.array(list(pieces), np.uint64) & np.uint64((1 << 20) - 1)] = True
            self.pieces[length] = (seen, pieces)

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, first word, last word) of the items in a text: each one's best stretch."""
        places: dict[int, set[int]] = {}
        for length, (seen, pieces) in self.pieces.items():
            hashes = rolling(codes, length)
            for at in np.flatnonzero(seen[hashes & np.uint64((1 << 20) - 1)]).tolist():
                for item, start in pieces.get(int(hashes[at]), ()):
                    places.setdefault(item, set()).add(at - start)
        out = []
        for item, begins in places.items():
            words, budget = self.words[item], self.budget[item]
            best, reach = (budget + 1, -1), -1
            for begin in sorted(begins):
                first, last = max(0, begin - budget), begin + len(words) + budget
                if last <= reach:
                    continue  # a stretch looked at already holds this one
                reach = last + budget
                distance, end = best_match(words, codes[first:reach].tolist())
                if distance < best[0]:
                    best = (distance, first + end)
                if not distance:
                    break
            if best[0] <= budget:
                out.append((item, best[0], max(0, best[1] - len(words) + 1), best[1]))
        return out


_INDEXED: dict[str, Items] = {}


class SharedItems:
    """A block of items on its way to the workers; each builds its index once and keeps one."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], edits: float, short: int):
        self.sent, self.how, self.mark = spark.sparkContext.broadcast(items), (edits, short), uuid.uuid4().hex

    def get(self) -> Items:
        if self.mark not in _INDEXED:
            _INDEXED.clear()
            _INDEXED[self.mark] = Items(self.sent.value, *self.how)
        return _INDEXED[self.mark]


def _find(shared: SharedItems):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.get()
        for batch in batches:
            ids, out = batch.column(0), []
            for first, texts in text_slices(batch, "text", SLICE_BYTES):
                for row, text in enumerate(texts, first):
                    out += [(row, items.ids[item], d, len(items.words[item]), a, b) for item, d, a, b in items.hits(CODES.of(text.split()))]
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), pa.array([o[1] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.int32()) for k in range(2, 6))],
                ["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"])

    return run


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read partition by partition."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def usable_items(benchmark: DataFrame) -> DataFrame:
    """benchmark + whether an item has a word to be searched for."""
    return benchmark.withColumn(free_name(benchmark, "usable"), F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]")))


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, short: int = SHORT) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, distance (word edits), item_words,
    first_word, last_word (of the stretch, counted in normalised words)."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {HITS}"
    found = [docs.select("doc_id", "text").mapInArrow(_find(SharedItems(spark, block, edits, short)), schema) for block in item_blocks(benchmark)]
    out = spark.createDataFrame([], schema) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _flag(shared: SharedItems):
    @F.arrow_udf("boolean")
    def contains(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = shared.get()
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([bool(items.hits(CODES.of(t.split()))) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], pa.bool_())

    return contains


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, short: int = SHORT) -> DataFrame:
    """docs without the documents that contain an item; a filter on the map side."""
    for block in item_blocks(benchmark):
        docs = docs.where(~_flag(SharedItems(docs.sparkSession, block, edits, short))(F.col("text")))
    return docs
