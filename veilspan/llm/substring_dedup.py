"""Substring dedup: windows of words that occur elsewhere, found with super-k-mers.

A window is ``window`` consecutive words of one document. Its minimiser is the ``seed`` consecutive
words in it with the smallest hash (the first of equals). Neighbouring windows mostly share it; such
a run is a super-k-mer, one packed string instead of many windows. Equal windows have equal
minimisers, so they meet in the minimiser's bucket, where sorting counts them exactly.

Most minimisers occur once in a corpus, and their windows with them. So first only (minimiser, hash
of the packed string, place) travels:

1. a minimiser with one occurrence: its windows are nowhere else;
2. a string with several occurrences: all its windows are repeated, without looking at it;
3. other strings of a minimiser with several: one packed string each goes to the bucket.

A minimiser with over ``FULL`` occurrences (a common line in many surroundings) would fill its bucket;
its windows go out one by one, under 128 bits of hash each, and are counted with partial sums. What is
repeated comes back as ranges of a document's words.

A word covered by a repeated window is removed; all windows are judged on the input. Null texts and
texts without words have no words; shorter texts have no window. Rows that repeat an id and a text
count as occurrences of each other. Null ids are told apart by the text. An empty table has an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored, text_slices

WINDOW, SEED = 35, 12
#: Occurrences of a minimiser up to which its strings are compared in one bucket.
FULL = 64
CACHED = 400_000
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SUPER = "doc_id bigint, tag int, pos int, n int, mini bigint, string_hash bigint"
MARKS = "doc_id bigint, tag int, pos int, n int"


class WordHashes(dict):
    """64-bit hashes of words, one cache per worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Spans:
    """Hashes of any stretch of a sequence of word hashes, from prefix sums of a polynomial."""

    def __init__(self, codes: np.ndarray, base: int = _BASE, inverse: int = _INVERSE):
        n = len(codes)
        power, self.back = (_powers(x, n) for x in (base, inverse))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:n], dtype=np.uint64)])

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[first]) * self.back[first] + (end - first).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    reach, n = 1, len(keys) - width + 1
    while reach * 2 <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[:n], keys[width - reach:width - reach + n])


def super_kmers(codes: np.ndarray, begins: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """For documents one after another in codes (begins: where each starts, and the end): place of the
    first word, number of windows, minimiser and string hash of each super-k-mer."""
    if len(codes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    spans, places = Spans(codes), np.arange(len(codes) - seed + 1)
    seeds = spans.hash(places, places + seed)
    low = np.uint64(0xFFFFFFFF)
    at = (_least((seeds & ~low) | places.astype(np.uint64), window - seed + 1) & low).astype(np.int64)
    ends = np.repeat(begins[1:], np.diff(begins))[:len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + window <= ends)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    at = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(starts) != 1)]))
    n = np.diff(np.concatenate([new, [len(starts)]]))
    first = starts[new]
    return first, n, seeds[at[new]], spans.hash(first, first + n + window - 1)


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    split = [t.split() for t in texts]
    return [w for s in split for w in s], np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)


def _find(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch, "text", SLICE_BYTES):
                words, begins = _words(texts)
                first, n, mini, string = super_kmers(HASHES.of(words), begins, window, seed)
                doc = np.searchsorted(begins, first, "right") - 1
                rows = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array((first - begins[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(string.view(np.int64))],
                    ["doc_id", "tag", "pos", "n", "mini", "string_hash"])

    return run


def _covered(n_words: int, ranges: list[dict], window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    depth = np.zeros(n_words + 1, np.int64)
    for r in ranges:
        depth[r["pos"]] += 1
        depth[r["pos"] + r["n"] + window - 1] -= 1
    return np.cumsum(depth[:-1]) > 0


def _finish(words: list[bytes], ranges: list[dict], window: int, digest: bool) -> tuple[int, int, str]:
    kept = words
    if ranges:
        gone = _covered(len(words), ranges, window)
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode()


_DONE = "doc_id bigint, tag int, n_words bigint, n_removed bigint, kept string"
_RANGES = "array<struct<pos:int,n:int>>"
_STRINGS = "array<struct<pos:int,n:int,mini:bigint,hot:boolean,copies:bigint>>"


def _first_pass(window: int, digest: bool):
    """Documents without strings to compare are finished; the others keep their words for later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, strings = batch.column("ranges"), batch.column("strings")
            for row, texts in text_slices(batch, "text", SLICE_BYTES):
                done, later = [], []
                for k, text in enumerate(texts, row):
                    words, waits = text.split(), strings[k].is_valid
                    done.append((None, None, None) if waits else _finish(words, ranges[k].as_py() or [], window, digest))
                    later.append(b" ".join(words) if waits else None)
                part = slice(row, row + len(texts))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], batch.column("tag")[part], *(pa.array([d[c] for d in done], t) for c, t in enumerate(
                        (pa.int64(), pa.int64(), pa.string()))), pa.array(later, pa.binary()), ranges[part], strings[part]],
                    ["doc_id", "tag", "n_words", "n_removed", "kept", "words", "ranges", "strings"])

    return run


def _last_pass(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, more = batch.column("ranges"), batch.column("found")
            for row, texts in text_slices(batch, "words", SLICE_BYTES):
                done = [_finish(t.split(), (ranges[k].as_py() or []) + (more[k].as_py() or []), window, digest) for k, t in enumerate(texts, row)]
                part = slice(row, row + len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("tag")[part], *(
                    pa.array([d[c] for d in done], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                    ["doc_id", "tag", "n_words", "n_removed", "kept"])

    return run


def _pack(window: int):
    """Super-k-mers as packed strings: the words of all windows of the run, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("mini", pa.int64()), ("copies", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("pos", pa.int32()),
                            ("n", pa.int32()), ("packed", pa.binary())])
        for batch in batches:
            for row, texts in text_slices(batch, "words", SLICE_BYTES):
                rows = []
                for k, text in enumerate(texts, row):
                    words, doc, tag = text.split(b" "), batch.column("doc_id")[k].as_py(), batch.column("tag")[k].as_py()
                    rows += [(s["mini"], s["copies"], doc, tag, s["pos"], s["n"], b" ".join(words[s["pos"]:s["pos"] + s["n"] + window - 1]))
                             for s in batch.column("strings")[k].as_py() if not s["hot"]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [
                    pa.array([], f.type) for f in schema], schema=schema)

    return run


def _unpack(window: int):
    """The windows of super-k-mers with a crowded minimiser, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["one", "two", "copies", "doc_id", "tag", "pos"]
        for batch in batches:
            for row, texts in text_slices(batch, "words", SLICE_BYTES):
                for k, text in enumerate(texts, row):
                    strings = [s for s in batch.column("strings")[k].as_py() if s["hot"]]
                    if not strings:
                        continue
                    codes = HASHES.of(text.split(b" "))
                    pos = np.concatenate([np.arange(s["pos"], s["pos"] + s["n"]) for s in strings])
                    copies = np.repeat([s["copies"] for s in strings], [s["n"] for s in strings])
                    one, two = (Spans(c).hash(pos, pos + window).view(np.int64) for c in (codes, _mix(codes)))
                    doc = pa.array([batch.column("doc_id")[k].as_py()] * len(pos), pa.int64())
                    tag = pa.array(np.full(len(pos), batch.column("tag")[k].as_py(), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(copies, pa.int64()), doc, tag, pa.array(pos.astype(np.int32))], names)

    return run


def count_bucket(rows: dict[str, list], window: int) -> list[tuple]:
    """Windows that occur more than once among packed strings: (row, offset, windows) of each run of them,
    in rows with one copy. Words get numbers, windows are sorted as such; nothing is hashed."""
    number: dict[bytes, int] = {}
    codes, owner, offset = [], [], []
    for k, packed in enumerate(rows["packed"]):
        words = np.array([number.setdefault(w, len(number)) for w in packed.split(b" ")], np.int32)
        codes.append(np.lib.stride_tricks.sliding_window_view(words, window))
        owner.append(np.full(len(codes[-1]), k))
        offset.append(np.arange(len(codes[-1])))
    if not codes:
        return []
    table, owner, offset = np.ascontiguousarray(np.concatenate(codes)), np.concatenate(owner), np.concatenate(offset)
    kinds = np.unique(table.view(f"V{4 * window}").ravel(), return_inverse=True)[1].ravel()
    copies = np.array(rows["copies"])
    often = np.bincount(kinds, weights=copies[owner])[kinds] > 1
    hit = np.flatnonzero(often & (copies[owner] == 1))
    if not len(hit):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)]))
    runs = np.diff(np.concatenate([new, [len(hit)]]))
    return list(zip(owner[hit[new]].tolist(), offset[hit[new]].tolist(), runs.tolist()))


def _count(window: int):
    """Buckets come sorted by minimiser; whole buckets are counted, an unfinished one waits for more."""

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        held = {c: rows.column(c).to_pylist() for c in ("packed", "copies", "doc_id", "tag", "pos")}
        found = count_bucket(held, window)
        return pa.RecordBatch.from_arrays([
            pa.array([held["doc_id"][k] for k, _, _ in found], pa.int64()), pa.array([held["tag"][k] for k, _, _ in found], pa.int32()),
            pa.array([held["pos"][k] + o for k, o, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int32())],
            ["doc_id", "tag", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = pa.Table.from_batches([batch.slice(first, 2048)])
                held = part if held is None else pa.concat_tables([held, part])
                mini = held.column("mini").to_numpy()
                whole = int(np.searchsorted(mini, mini[-1]))
                if whole:
                    yield ranges(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None:
            yield ranges(held)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept: the kept words joined by blanks, or with
    ``digest`` only its SHA-256."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("tag"), "text")
    runs = stored(keyed.mapInArrow(_find(window, seed), SUPER), "super-kmers")
    often = stored(runs.groupBy("mini").agg(
        F.count(F.lit(1)).alias("seen"), F.min("string_hash").alias("a"), F.max("string_hash").alias("b")).where("seen > 1").select(
        "mini", (F.col("a") == F.col("b")).alias("alone"), (F.col("seen") > FULL).alias("hot")), "minimisers")
    repeated = stored(runs.join(often, "mini"), "repeated-minimisers")
    mixed = repeated.where("not alone")
    place = F.struct("doc_id", "tag", "pos", "n", "hot")
    strings = stored(mixed.groupBy("mini", "string_hash").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("p")), "strings")
    copied = mixed.join(strings.where("copies > 1").select("mini", "string_hash"), ["mini", "string_hash"], "left_semi")
    known = repeated.where("alone").select("doc_id", "tag", "pos", "n").unionByName(copied.select("doc_id", "tag", "pos", "n"))
    compare = strings.select("p.doc_id", "p.tag", F.struct("p.pos", "p.n", "mini", "p.hot", "copies").alias("s"))
    by_doc = known.select("doc_id", "tag", F.struct("pos", "n").alias("r"), F.lit(None).cast(_STRINGS[6:-1]).alias("s")).unionByName(
        compare.select("doc_id", "tag", F.lit(None).cast(_RANGES[6:-1]).alias("r"), "s")).groupBy("doc_id", "tag").agg(
        F.collect_set("r").alias("ranges"), F.collect_set("s").alias("strings")).select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "ranges", F.when(F.size("strings") > 0, F.col("strings")).alias("strings"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    first = stored(keyed.join(by_doc, same, "left").select("doc_id", "tag", "text", "ranges", "strings").mapInArrow(
        _first_pass(window, digest), f"{_DONE}, words binary, ranges {_RANGES}, strings {_STRINGS}"), "first-pass")
    waiting = first.where("words is not null")
    packed = waiting.select("doc_id", "tag", "words", "strings").where(F.exists("strings", lambda s: ~s["hot"])).mapInArrow(
        _pack(window), "mini bigint, copies bigint, doc_id bigint, tag int, pos int, n int, packed binary")
    # rows that repeat an id and a text pack the same places, but their strings have several copies anyway
    in_buckets = packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(_count(window), MARKS)
    single = waiting.select("doc_id", "tag", "words", "strings").where(F.exists("strings", lambda s: s["hot"])).mapInArrow(
        _unpack(window), "one bigint, two bigint, copies bigint, doc_id bigint, tag int, pos int")
    single = stored(single, "crowded-windows")
    # stored, so that the join shuffles both sides and adaptive execution can split a window that many hold
    crowded = stored(single.groupBy("one", "two").agg(F.sum("copies").alias("all")).where("all > 1"), "repeated-windows")
    one_by_one = single.where("copies = 1").join(crowded, ["one", "two"], "left_semi").select("doc_id", "tag", "pos", F.lit(1).alias("n"))
    found = in_buckets.unionByName(one_by_one).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("found")).select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "found")
    last = waiting.join(found, same, "left").select("doc_id", "tag", "words", "ranges", "found").mapInArrow(_last_pass(window, digest), _DONE)
    columns = ("doc_id", "n_words", "n_removed", "kept")
    return first.where("words is null").select(*columns).unionByName(last.select(*columns))
