"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is normalised to its words: lower case, letters and digits only, runs of digits as one 0. Lines
of fewer than ``exact`` words are left alone, those of fewer than ``least`` are only merged with equal
ones. Two lines are linked if their normal forms are equal, or
if their SimHashes (64 bits over the different words) differ in at most three bits and the edit similarity of
the normal forms (1 - edits / longer length, in characters) is 0.8 or more. Of each connected group
the first occurrence stays, by document id and line number; the others are cut out.

SimHashes are cut into five blocks. Three differing bits touch three blocks at most, so two blocks
are equal: ten keys of two blocks each bring every pair together, and a key of 25 bits or more keeps
chance meetings few. Equal lines are merged first and equal SimHashes once more, so hot lines enter
once. A key's bucket returns for each SimHash the smallest one it hangs together with, not its pairs.
Lines of one such cluster are then compared exactly; a cluster of many different lines is cut into
tiles, every pair of tiles being a task's group.

Documents without lines to compare are finished at once; texts of the others wait until groups are
known. Null texts are empty and have one empty line. Null ids come last; rows that repeat an id and
a text count as one document. An empty table has an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored, text_slices
from veilspan.llm.graph import components
from veilspan.llm.near_dedup import _unite

LEAST, BITS, SIMILAR = 5, 3, 0.8
#: Different lines of a cluster that one group compares with one another.
TILE = 256
CACHED = 1_000_000
SLICE_BYTES, LINE_BYTES = 1 << 19, 1 << 22
LINE = "doc_id bigint, tag int, line int, one bigint, two bigint, simhash bigint"
_KEPT, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"[0-9]+")
_ENDS = ".,;:!?\"'()[]*#$%&-|"
_EDGES = (0, 13, 26, 39, 52, 64)
MASKS = tuple(sum(((1 << _EDGES[b + 1]) - (1 << _EDGES[b])) for b in pair) for pair in combinations(range(5), 2))
#: A byte's bits, one in each byte of a number.
_SPREAD = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def normal_word(word: str) -> str:
    return _DIGITS.sub("0", "".join(_KEPT.findall(word.lower())))


def normal_line(line: bytes) -> str:
    return " ".join(w for w in map(normal_word, line.decode().split()) if w)


class LineWords(dict):
    """64-bit codes of normalised words, 0 for those of which nothing is left; one cache per worker."""

    def __missing__(self, word: bytes) -> int:
        # the ends are taken off first, as most words are letters then; str.split() knows more blanks than
        # bytes.split(), so a word here may hold several there
        plain = word.decode().lower().strip(_ENDS)
        if not plain.isalpha():
            plain = normal_line(word)
        value = self[word] = xxhash.xxh64_intdigest(plain, 3) if plain else 0
        return value


WORDS = LineWords()


def line_rows(lines: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(line, hash, second hash, simhash, words) of the lines that have enough words."""
    if len(WORDS) > CACHED:
        WORDS.clear()
    split = pc.ascii_split_whitespace(pa.array(lines, pa.string()))  # at the bytes of bytes.split()
    # each different word of the slice is looked up once; what is done before changes no normal form
    words = pc.ascii_trim(pc.ascii_lower(split.flatten()), _ENDS).dictionary_encode()
    known = np.fromiter(map(WORDS.__getitem__, _as_bytes(words.dictionary)), np.uint64, len(words.dictionary))
    at = words.indices.to_numpy()
    owner = np.repeat(np.arange(len(lines)), np.diff(split.offsets.to_numpy()))
    filled = known[at] != 0
    owner, at = owner[filled], at[filled]
    counts = np.bincount(owner, minlength=len(lines))
    enough = counts[owner] >= least
    owner, at = owner[enough], at[enough]
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    codes = known[at]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    n = np.diff(np.concatenate([begins, [len(owner)]]))
    place = (np.arange(len(owner)) - np.repeat(begins, n)).astype(np.uint64)
    mixed = [np.add.reduceat((codes ^ (place * f)) * (f + (place << np.uint64(1))), begins) for f in _FACTORS]
    # words count once in a line; else frequent ones would make all long lines of a language alike
    different, number = np.unique(known, return_inverse=True)
    shift = len(different).bit_length()
    pair = np.sort((owner << shift) | number[at])
    pair = pair[np.concatenate([[True], np.diff(pair) != 0])]
    simhash = _simhashes(different[pair & ((1 << shift) - 1)], np.flatnonzero(np.concatenate([[True], np.diff(pair >> shift) != 0])))
    return owner[begins], mixed[0] ^ (mixed[0] >> np.uint64(31)), mixed[1] ^ (mixed[1] >> np.uint64(31)), simhash, n


def _as_bytes(words: pa.StringArray) -> list[bytes]:
    """As to_pylist(), but in a tenth of its time."""
    data, ends = words.buffers()[2].to_pybytes(), np.frombuffer(words.buffers()[1], np.int32)[words.offset:][:len(words) + 1].tolist()
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def _simhashes(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits that more than half the features from each start to the next have. Eight bits are counted in the
    bytes of one number, in runs of 255 features at most, so no byte overflows."""
    sizes = np.diff(np.concatenate([starts, [len(features)]]))
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    parts = features.astype("<u8").view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_SPREAD[parts[:, k]], cuts) for k in range(8)], axis=1).astype("<u8").view(np.uint8)
    ones = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def _lines(least: int, exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch, "text", LINE_BYTES):
                split = [t.split(b"\n") for t in texts]
                doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
                number = np.concatenate([np.arange(len(s)) for s in split])
                at, one, two, simhash, n = line_rows([line for s in split for line in s], exact)
                rows = pa.array(doc[at] + row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(number[at].astype(np.int32)),
                    pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(simhash, mask=n < least)], ["doc_id", "tag", "line", "one", "two", "simhash"])

    return run


def _block_links(bits: int):
    """Runs of one key -> (a, b): each SimHash and the smallest one it hangs together with."""

    def links(masked: np.ndarray, simhash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(masked[0]) != 0) | (np.diff(masked[1]) != 0)]))
        ends = np.concatenate([begins[1:], [len(simhash)]])
        two = begins[ends - begins == 2]  # most buckets that are shared at all
        low, high = np.minimum(simhash[two], simhash[two + 1]), np.maximum(simhash[two], simhash[two + 1])
        near = (np.bitwise_count(low ^ high) <= bits) & (low != high)
        a, b = [high[near]], [low[near]]
        for x, y in zip(begins[ends - begins > 2].tolist(), ends[ends - begins > 2].tolist()):
            points = np.unique(simhash[x:y])
            label = np.arange(len(points))
            for first in range(0, len(points), 512):
                i, j = np.nonzero(np.bitwise_count(points[first:first + 512][:, None] ^ points[None, first:]) <= bits)
                _unite(label, i + first, j + first)
            linked = label != np.arange(len(points))
            a.append(points[linked])
            b.append(points[label[linked]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        masks = np.array([m - (1 << 64) if m >= 1 << 63 else m for m in MASKS], np.int64)
        for batch in batches:
            combo, simhash = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("combo", "simhash")))
            masked = simhash & masks[combo]
            last = (combo == combo[-1]) & (masked == masked[-1])
            whole = len(combo) - int(last[::-1].argmin() if not last.all() else len(last))
            held = [combo[whole:], simhash[whole:]]
            if whole:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, links((combo[:whole], masked[:whole]), simhash[:whole]))), ["a", "b"])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, links((held[0], held[1] & masks[held[0]]), held[1]))), ["a", "b"])

    return run


def _masked() -> Column:
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in MASKS]
    return F.col("simhash").bitwiseAND(F.element_at(F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>"), F.col("combo") + 1))


def simhash_clusters(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """hashes (simhash, distinct) -> (node, root) of those that hang together with another."""
    keys = hashes.select("simhash", F.explode(F.sequence(F.lit(0), F.lit(len(MASKS) - 1))).alias("combo"))
    # sorted by the 64 bits first: most comparisons end with them, without a look at the rows
    keyed = keys.repartition(F.col("combo"), _masked()).sortWithinPartitions(_masked(), F.col("combo"))
    return components(keyed.select("combo", "simhash").mapInArrow(_block_links(bits), "a bigint, b bigint"))


def edit_distance(a: str, b: str, limit: int = 1 << 30) -> int:
    """Characters to insert, delete or replace: Myers' bit vectors, after equal ends are taken off. Once the
    rest of b cannot bring the distance down to ``limit``, some number above it is returned."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first:len(a) - last], b[first:len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b), 0, -1), b):
        if score - left > limit:
            return limit + 1
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return score


def alike(a: str, b: str, similar: float) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - similar) * longer + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


def _verify(bits: int, similar: float):
    """The lines of a tile, or of two: links (a, b) that connect all that are alike. Lines that hang
    together already are not compared again."""

    def run(group: pa.Table) -> pa.Table:
        rows = dict(zip(group.column("one").to_pylist(), zip(group.column("simhash").to_pylist(), group.column("words").to_pylist())))
        ids = sorted(rows)
        prints = np.array([rows[i][0] for i in ids], np.int64)
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i in range(len(ids)):
            for j in (np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= bits) + i + 1).tolist():
                x, y = root(i), root(j)
                if x != y and alike(rows[ids[i]][1], rows[ids[j]][1], similar):
                    parent[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


_FETCH = "struct<line:int,one:bigint,simhash:bigint,cluster:bigint,tiles:int>"


def _first_pass():
    """Cuts out known repeats; documents with lines in clusters keep their text for later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, waits = batch.column("gone"), batch.column("waits").to_pylist()
            for row, texts in text_slices(batch, "text", SLICE_BYTES):
                done, later = [], []
                for k, text in enumerate(texts, row):
                    done.append((None, None, None) if waits[k] else cut(text, gone[k].as_py() or []))
                    later.append(text if waits[k] else None)
                part = slice(row, row + len(texts))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], batch.column("tag")[part],
                    *_kept(done), pa.array(later, pa.binary()), gone[part], batch.column("fetch")[part]],
                    ["doc_id", "tag", "n_lines", "n_removed", "text", "later", "gone", "fetch"])

    return run


def cut(text: bytes, gone: list[int]) -> tuple[int, int, bytes]:
    if not gone:
        return text.count(b"\n") + 1, 0, text
    lines, out = text.split(b"\n"), set(gone)
    return len(lines), len(out), b"\n".join(x for k, x in enumerate(lines) if k not in out)


def _kept(done: list[tuple]) -> list[pa.Array]:
    """Columns n_lines, n_removed, text."""
    return [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2] for d in done], pa.binary()).cast(pa.string())]


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, more = batch.column("gone"), batch.column("more")
        for row, texts in text_slices(batch, "later", SLICE_BYTES):
            done = [cut(t, (gone[k].as_py() or []) + (more[k].as_py() or [])) for k, t in enumerate(texts, row)]
            part = slice(row, row + len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("tag")[part], *_kept(done)],
                                             ["doc_id", "tag", "n_lines", "n_removed", "text"])


def _fetch_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("one", "simhash", "cluster", "tiles")
    for batch in batches:
        texts, rows = batch.column("later"), []
        for k, fetch in enumerate(batch.column("fetch").to_pylist()):
            lines = texts[k].as_py().split(b"\n")
            rows += [(*(f[c] for c in names), normal_line(lines[f["line"]])) for f in fetch]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], [*names, "words"])


def line_dedup(docs: DataFrame, least: int = LEAST, bits: int = BITS, similar: float = SIMILAR, exact: int = LEAST) -> DataFrame:
    """Per row of docs: doc_id, text (without the lines that are repeated), n_lines, n_removed. With
    ``exact`` = 1 every line that has a word is merged with its equals; shorter ones have no SimHash."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("tag"), "text")
    lines = stored(keyed.mapInArrow(_lines(least, exact), LINE), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "line")
    kinds = stored(lines.groupBy("one", "two", "simhash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-kinds")
    hashes = stored(kinds.where("simhash is not null").groupBy("simhash").agg(F.count(F.lit(1)).alias("kinds")), "line-hashes")
    clusters = simhash_clusters(hashes.select("simhash"), bits).withColumnRenamed("node", "simhash")
    of = hashes.join(clusters, "simhash", "left").withColumn("cluster", F.coalesce("root", "simhash"))
    sizes = of.groupBy("cluster").agg(F.sum("kinds").alias("lines")).where("lines > 1")
    several = stored(of.join(sizes, "cluster").select("simhash", "cluster", F.ceil(F.col("lines") / TILE).cast("int").alias("tiles")), "line-clusters")
    marked = stored(kinds.join(several, "simhash", "left").where("n > 1 or cluster is not null").drop("n"), "marked-lines")

    def in_docs(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    hit = lines.join(marked.drop("simhash"), ["one", "two"])
    later, own = F.col("cluster").isNotNull(), place.eqNullSafe(F.col("first"))
    by_doc = in_docs(hit.groupBy("doc_id", "tag").agg(
        F.collect_set(F.when(~later & ~own, F.col("line"))).alias("gone"), F.max(later).alias("waits"),
        F.collect_set(F.when(later & own, F.struct("line", "one", "simhash", "cluster", "tiles"))).alias("fetch")))
    first = stored(keyed.join(by_doc, same, "left").select(
        "doc_id", "tag", "text", "gone", F.coalesce("waits", F.lit(False)).alias("waits"), "fetch").mapInArrow(
        _first_pass(), f"doc_id bigint, tag int, n_lines bigint, n_removed bigint, text string, later binary, gone array<int>, fetch array<{_FETCH}>"),
        "line-first-pass")
    waiting = first.where("later is not null")
    fetched = waiting.where("size(fetch) > 0").select("later", "fetch").mapInArrow(
        _fetch_lines, "one bigint, simhash bigint, cluster bigint, tiles int, words string").withColumn(
        "t", F.pmod(F.xxhash64("one"), F.col("tiles")).cast("int"))
    tiles = fetched.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "cluster", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "one", "simhash", "words")
    links = tiles.groupBy("cluster", "t", "u").applyInArrow(_verify(bits, similar), "a bigint, b bigint")
    groups = components(links).select(F.col("node").alias("one"), "root")
    grouped = stored(marked.where("cluster is not null").join(groups, "one", "left").select(
        "one", "two", "first", F.coalesce("root", "one").alias("root")), "line-groups")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    of_kind = grouped.select("one", "two", "root").join(stays, "root").select("one", "two", "stays")
    more = in_docs(lines.join(of_kind, ["one", "two"]).where(~place.eqNullSafe(F.col("stays"))).groupBy("doc_id", "tag").agg(
        F.collect_set("line").alias("more")))
    last = waiting.join(more, same, "left").select("doc_id", "tag", "later", "gone", "more").mapInArrow(
        _last_pass, "doc_id bigint, tag int, n_lines bigint, n_removed bigint, text string")
    columns = ("doc_id", "text", "n_lines", "n_removed")
    return first.where("later is null").select(*columns).unionByName(last.select(*columns))
