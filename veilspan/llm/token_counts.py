"""Token counts by a two-tier lookup of pre-tokens, on the map side.

A pre-token is a run of blanks with the word behind it. No piece of such a vocabulary has a blank
after another character (checked when it is loaded), so no merge crosses the start of a pre-token
and a text has as many tokens as its pre-tokens together.

Tier one is a broadcast table of the most frequent pre-tokens and their lengths; it is bounded by
``FREQUENT`` entries of at most ``LONGEST`` bytes, whatever the corpus. Tier two is a cache in each
worker for the rest, encoded once per worker while the cache lasts. Pre-tokens are not shuffled:
the frequent ones come from a sample of about ``SAMPLE`` texts, read by ``SAMPLE_TASKS`` tasks that each
hand one summary of bounded size to the driver. The table decides about speed only, never about a count.

Null texts are empty and have no tokens. Texts that hold the vocabulary's own blank sign are encoded
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import text_slices

FREQUENT = 65_536
LONGEST = 32
#: Texts that the table is made from, tasks that read them, pre-tokens that a task hands on and holds meanwhile.
SAMPLE, SAMPLE_TASKS, SUMMARY, SUMMARY_HELD, SEED = 32_768, 16, 32_768, 200_000, 29
CACHED = 400_000
SLICE_BYTES = 1 << 20
SIGN = "▁"
_RUNS = re.compile(rb" *[^ ]+| +")


def pre_tokens(text: bytes) -> list[bytes]:
    """The pre-tokens, less the one blank that each begins with (the model puts one before a text)."""
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ") if text else []
    runs = _RUNS.findall(b" " + text)
    last = runs[-1]
    return [r[1:] for r in runs[:-1]] + [last[1:] if last != b" " else b" \0"]  # a single blank at the end is marked


class PieceCounter:
    """Counts of tokens from those of pre-tokens; one per worker process and table."""

    _of: dict[tuple[str, int], PieceCounter] = {}

    def __init__(self, path: str, frequent: tuple[bytes, bytes]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        if any(SIGN in self.model.id_to_piece(i).lstrip(SIGN) for i in range(size)):
            raise ValueError("pieces of this model cross white space")
        keys, lengths = frequent
        self.frequent = dict(zip(keys.split(b" "), np.frombuffer(lengths, np.uint8).tolist())) if lengths else {}
        self.known = dict(self.frequent)

    @classmethod
    def of(cls, path: str, table: Broadcast) -> PieceCounter:
        key = (path, id(table.value))
        if key not in cls._of:
            cls._of = {key: cls(path, table.value)}
        return cls._of[key]

    def lengths(self, keys: list[bytes]) -> list[int]:
        return [1 if key == b" \0" else n for key, n in zip(keys, map(len, self.model.encode([k.decode() for k in keys], num_threads=1)))]

    def count(self, texts: list[bytes]) -> list[int]:
        whole = [i for i, text in enumerate(texts) if b"\xe2\x96\x81" in text or b"\0" in text]
        parts = [pre_tokens(text) for text in texts]
        for i in whole:
            parts[i] = []
        new = list(set().union(*parts).difference(self.known))
        if len(self.known) + len(new) > CACHED + len(self.frequent):
            self.known = dict(self.frequent)
            new = list(set().union(*parts).difference(self.known))
        self.known.update(zip(new, self.lengths(new)))
        counts = [sum(map(self.known.__getitem__, each)) for each in parts]
        for i in whole:
            counts[i] = len(self.model.encode(texts[i].decode()))
        return counts


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for _, texts in text_slices(batch, "text", SLICE_BYTES):
            for text in texts:
                seen.update(pre_tokens(text))
            if len(seen) > SUMMARY_HELD:
                seen = Counter(dict(seen.most_common(SUMMARY_HELD // 4)))
    top = [(k, n) for k, n in seen.most_common(SUMMARY) if n > 1 and 0 < len(k) <= LONGEST and b" " not in k and b"\0" not in k]
    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k for k, _ in top)]), pa.array([np.array([n for _, n in top], np.int64).tobytes()])], ["pieces", "counts"])


def frequent_table(docs: DataFrame, model: str, entries: int = FREQUENT) -> Broadcast:
    """The table of tier one as a broadcast: (pre-tokens joined by blanks, a byte of length each)."""
    texts = docs.select("text")
    rate = SAMPLE / max(texts.count(), SAMPLE)
    total: Counter = Counter()
    for r in texts.sample(rate, SEED).repartition(SAMPLE_TASKS).mapInArrow(_summary, "pieces binary, counts binary").collect():  # a row per task
        if r["counts"]:
            total.update(dict(zip(bytes(r["pieces"]).split(b" "), np.frombuffer(r["counts"], np.int64).tolist())))
    keys = sorted(total, key=lambda k: (-total[k], k))[:entries]
    lengths = PieceCounter(model, (b"", b"")).lengths(keys)
    return docs.sparkSession.sparkContext.broadcast((b" ".join(keys), np.array(lengths, np.uint8).tobytes()))


def token_count(model: str, table: Broadcast):
    """A column function text -> number of tokens."""

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter.of(model, table)
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([n for _, part in text_slices(batch, "text", SLICE_BYTES) for n in counter.count(part)], pa.int64())

    return count


def count_tokens(docs: DataFrame, model: str, name: str = "n_tokens") -> DataFrame:
    """docs + the number of tokens of ``text``."""
    return docs.withColumn(name, token_count(model, frequent_table(docs, model))(F.col("text")))

