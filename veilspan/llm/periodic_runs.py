"""Periodic runs of words, found with a run-length grammar that answers how far two places agree.

The texts of a slice are laid end to end as numbers, a mark of its own between two. Recompression turns
this sequence into a grammar: block compression replaces repeats of one symbol by a symbol for (symbol,
count), pair compression replaces each pair of a left and a right symbol by one for the pair, where a hash
splits the symbols into left and right; both in turn until one symbol is left. Equal stretches are
parsed alike except at their borders, so how far two places agree is answered by climbing while both
stand at the border of a symbol and descending where they differ: a few steps per level.

A run of period p and length L has L - p places i whose word is that of i + p. These are at least
max(least - p, (times - 1) * p) in a row, so a grid of that width meets each run (a harmonic sum of grid
places over all periods). Grid places whose words agree are extended both ways by the grammar. A period
that is a multiple of a smaller one reaches equally far; the smallest of a stretch is kept.

A text stays in one row of one task; time per word grows with the logarithm of the longest text of its
slice, memory with the slice or, if larger, with one text. Nothing is shuffled.

Null texts count as empty: no words, no runs, an empty rest. Equal texts have equal runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import text_slices

#: A run has at least so many words and at least so many periods.
LEAST, TIMES = 24, 3
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass(frozen=True)
class Level:
    """Symbols of one level; ``up`` has the place of each one's parent in the next level, ``first`` the
    place of each parent's first child, and one entry more for the end."""

    symbols: np.ndarray
    up: np.ndarray
    first: np.ndarray
    block: bool


def _mixed(symbols: np.ndarray, seed: int) -> np.ndarray:
    """True for right symbols: one bit of a multiplicative hash that changes with the level."""
    x = (symbols.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63) == 1


class Grammar:
    """Of a sequence of numbers from 0 whose first and last one occur once."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[Level] = []
        self._names, seed = int(symbols.max()) + 1, 0
        while len(symbols) > 1:
            symbols = self._pairs(self._blocks(symbols), seed)
            seed += 1

    def _blocks(self, s: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(first) == len(s):
            return s
        counts = np.diff(np.append(first, len(s)))
        return self._add(s, first, counts > 1, counts, True)

    def _pairs(self, s: np.ndarray, seed: int) -> np.ndarray:
        if len(s) < 2:
            return s
        right = _mixed(s, seed)
        ahead, back = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        begins = ahead if np.count_nonzero(ahead) >= np.count_nonzero(back) else back
        first = np.flatnonzero(~np.concatenate([[False], begins]))
        if len(first) == len(s):
            return s
        return self._add(s, first, np.append(begins, False)[first], s[np.minimum(first + 1, len(s) - 1)], False)

    def _add(self, s: np.ndarray, first: np.ndarray, new: np.ndarray, second: np.ndarray, block: bool) -> np.ndarray:
        """One level more: parents with ``new`` are named by (symbol, second), the others keep the symbol."""
        bounds = np.append(first, len(s))
        self.levels.append(Level(s.astype(np.int32), np.repeat(np.arange(len(first), dtype=np.int32), np.diff(bounds)), bounds, block))
        above = s[first]
        names, named = np.unique(above[new] * (max(self._names, len(s)) + 1) + second[new], return_inverse=True)
        above[new] = self._names + named
        self._names += len(names)
        return above

    def agree(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from the places a and b on are equal, forwards (step 1) or backwards (-1);
        no a equals its b."""
        pa_, pb = a.copy(), b.copy()
        held = np.full(len(a), len(self.levels))

        def rest(level: Level, x: np.ndarray, parent: np.ndarray) -> np.ndarray:
            """Symbols from x to its parent's end, x too."""
            return level.first[parent + 1] - x if step > 0 else x - level.first[parent] + 1

        live = np.arange(len(a))
        for k, level in enumerate(self.levels):
            x, y = pa_[live], pb[live]
            same = level.symbols[x] == level.symbols[y]
            held[live[~same]] = k
            live, x, y = live[same], x[same], y[same]
            if not len(live):
                break
            up_x, up_y = level.up[x], level.up[y]
            rest_x, rest_y = rest(level, x, up_x), rest(level, y, up_y)
            border = (rest_x == level.first[up_x + 1] - level.first[up_x]) & (rest_y == level.first[up_y + 1] - level.first[up_y])
            ahead = np.where(border, 0, np.minimum(rest_x, rest_y)) * step
            x, y, climbs = x + ahead, y + ahead, border | (rest_x == rest_y)
            held[live[~climbs]] = k
            pa_[live], pb[live] = np.where(climbs, level.up[x], x), np.where(climbs, level.up[y], y)
            live = live[climbs]
        for k in range(len(self.levels), 0, -1):
            down = np.flatnonzero(held >= k)
            if len(down):
                level, x, y = self.levels[k - 1], pa_[down], pb[down]
                sizes = np.minimum(level.first[x + 1] - level.first[x], level.first[y + 1] - level.first[y])
                x, y = (level.first[x], level.first[y]) if step > 0 else (level.first[x + 1] - 1, level.first[y + 1] - 1)
                ahead = np.where(level.symbols[x] == level.symbols[y], sizes if level.block else 1, 0) * step
                pa_[down], pb[down] = x + ahead, y + ahead
        return np.abs(pa_ - a)


def grid_pairs(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) on the harmonic grid whose words agree. Texts begin at ``begins`` and get no
    longer, so that each period is searched in a beginning of the sequence."""
    places, periods = [], []
    for p in range(1, int(sizes[0]) // times + 1 if len(sizes) else 0):
        fit = int(np.searchsorted(-sizes, -max(least, times * p), side="right"))
        if not fit:
            break
        end, width = int(begins[fit - 1] + sizes[fit - 1]) - p, max(least - p, (times - 1) * p)
        hit = np.flatnonzero(symbols[:end:width] == symbols[p:end + p:width])
        if len(hit):
            places.append(hit * width)
            periods.append(np.full(len(hit), p))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, in order of text, start, period."""
    nothing = (np.zeros(0, np.int64),) * 4
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= least), key=lambda k: -len(texts[k]))
    if not order:
        return nothing
    sizes = np.array([len(texts[k]) for k in order])
    begins = 1 + np.cumsum(sizes + 1) - sizes - 1
    total = int(begins[-1] + sizes[-1]) + 1
    seen: dict[bytes, int] = {}
    symbols = np.arange(total)
    for k, begin in zip(order, begins.tolist()):
        symbols[begin:begin + len(texts[k])] = list(map(seen.setdefault, texts[k], range(begin, begin + len(texts[k]))))
    at, period = grid_pairs(symbols, begins, sizes, least, times)
    if not len(at):
        return nothing
    grammar = Grammar(symbols)
    start = at - grammar.agree(at - 1, at + period - 1, -1)
    length = at + grammar.agree(at, at + period, 1) + period - start
    fits = length >= np.maximum(least, times * period)
    start, length, period = start[fits], length[fits], period[fits]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[:len(start)]
    start, length, period = start[new], length[new], period[new]
    place = np.searchsorted(begins, start, side="right") - 1
    text = np.array(order)[place]
    start = start - begins[place]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def word_runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """STRUCT<n_words, runs, collapsed> of each text: all maximal runs by start and period, and the words
    that no run repeats after its first period, joined by one space."""

    @F.arrow_udf(f"struct<n_words:bigint,runs:{RUNS},collapsed:string>")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in columns:
            sizes, counts, found, rests = [], [], [[], [], []], []
            for _, part in text_slices(pa.RecordBatch.from_arrays([each], ["text"]), "text", SLICE_BYTES):
                texts = [t.split() for t in part]
                of_text, *runs = runs_of(texts, least, times)
                ends = np.searchsorted(of_text, np.arange(len(texts) + 1))
                sizes += map(len, texts)
                counts.append(np.diff(ends))
                for column, values in zip(found, runs):
                    column.append(values)
                for words, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist()):
                    for run in range(b - 1, a - 1, -1):  # marks stay in place, so the order is free
                        start, length, period = (int(c[run]) for c in runs)
                        words[start + period:start + length] = [None] * (length - period)
                    rests.append(b" ".join(words if a == b else [w for w in words if w is not None]))
            starts, lengths, periods = (pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in found)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([starts, lengths, periods], ["start", "length", "period"]))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), runs, pa.array(rests, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return of(text)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row per row of docs. Other columns are not carried, so none can clash."""
    return docs.select("doc_id", word_runs(F.col("text"), least, times).alias("of")).select("doc_id", "of.*")


def longest_run(runs: Column) -> Column:
    """The run of greatest exact length / period, of equals the first; null without runs."""
    return F.aggregate(
        runs, F.get(runs, F.lit(0)),
        lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
