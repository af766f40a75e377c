"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by id and encoded in order; every partition writes three flat files,
little-endian: ``.ids`` (token ids; 16 bits each if the vocabulary fits, else 32), ``.off`` (64-bit
offsets of the documents within the file, one more than documents), ``.doc`` (64-bit ids). The
manifest has a row per file. Where a file begins in the whole corpus is the prefix sum of the token
counts before it, so no task waits for another. Readers map the files into memory.

A task attempt writes under a name of its own and the manifest names the files of the attempt that
counted, so retries and lost executors leave unused files at most.

Byte-pair encodings of this kind never look across white space: a text's ids are those of its words
in order. Words come from a cache in each worker. New words of Latin letters with punctuation behind
them are two pre-tokens that recur more often than the word; many are encoded in one call, as the
end-of-word mark of the vocabulary says where each ends.

Null texts are empty and have only the end id. Null ids come first, in order of the text's hash;
repeated ids follow each other the same way. An empty table has an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import new_folder, stored, text_slices

#: Words, and letters or marks of words, whose ids one worker keeps; beyond it the cache starts anew.
CACHED_WORDS, CACHED_PARTS = 1_000_000, 500_000
SLICE_BYTES = 1 << 20
#: Letters that stay one pre-token and one letter when they are lower-cased, then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
MANIFEST = "part int, file string, docs bigint, null_ids bigint, tokens bigint, width int"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class WordEncoder:
    """Token ids of texts, as bytes, from the ids of their words."""

    _of: dict[tuple[str, int], WordEncoder] = {}

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = f"<u{width}"
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.marked = bool(suffix)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str, width: int) -> WordEncoder:
        """One per worker process, so tasks share the cache."""
        if (path, width) not in cls._of:
            cls._of[path, width] = cls(path, width)
        return cls._of[path, width]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [text.split() for text in texts]
        new = list(set().union(*words).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known = {}
            new = list(set().union(*words))
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, each)) for each in words]

    def _learn(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for word in words:
            text = word.decode()
            cut = _PLAIN.fullmatch(text) if self.marked else None
            if cut:
                plain.append((word, cut[1].lower(), cut[2]))
            else:
                rest.append((word, text))
        if len(self.parts) > CACHED_PARTS:
            self.parts = {}
        new = list({part for _, *parts in plain for part in parts if part}.difference(self.parts))
        if new:
            ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(new):
                raise ValueError("a pre-token has no end of its own")
            width, data = int(self.kind[2:]), ids.astype(self.kind).tobytes()
            bounds = [0, *(cuts * width).tolist()]
            self.parts.update((part, data[a:b]) for part, a, b in zip(new, bounds, bounds[1:]))
        for word, letters, marks in plain:
            self.known[word] = self.parts[letters] + self.parts[marks] if marks else self.parts[letters]
        found = self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False)
        self.known.update((word, np.array(e.ids, self.kind).tobytes()) for (word, _), e in zip(rest, found))


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (file:, hdfs:, s3: and so on, or a plain path) and the path in it."""
    return pafs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (pafs.LocalFileSystem(), folder)


def _write_part(folder: str, path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(path, width), np.array([end_id], f"<u{width}").tobytes()
        files, base = file_system(folder)
        name, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None
        ids: list[int | None] = []
        lengths = [np.zeros(1, "<u8")]
        for batch in batches:
            if out is None:
                files.create_dir(base, recursive=True)
                out = files.open_output_stream(f"{base}/{name}.ids")
            ids += batch.column(0).to_pylist()
            for _, texts in text_slices(batch, "text", SLICE_BYTES):
                encoded = encoder.encode(texts)
                lengths.append(np.fromiter(((len(e) + len(end)) // width for e in encoded), "<u8", len(encoded)))
                out.write(end.join(encoded) + end)
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(lengths), dtype="<u8")
        nulls = sum(i is None for i in ids)
        for kind, values in (("off", offsets), ("doc", np.array([i or 0 for i in ids], "<i8"))):
            with files.open_output_stream(f"{base}/{name}.{kind}") as to:
                to.write(values.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": f"{folder}/{name}", "docs": len(ids), "null_ids": nulls,
                                           "tokens": int(offsets[-1]), "width": width}], pa.schema([
                                               ("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("null_ids", pa.int64()),
                                               ("tokens", pa.int64()), ("width", pa.int32())]))

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ids of docs (doc_id, text) in ascending order of doc_id; the manifest, with ``base``: ids
    in all files before. The manifest has a row per partition; only that comes to the driver."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(ranged.mapInArrow(_write_part(folder, tokenizer, end_id, width), MANIFEST), "token-manifest")
    rows, base = [], 0
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], r["file"], r["docs"], r["null_ids"], r["tokens"], r["width"], base))
        base += r["tokens"]
    return stored(spark.createDataFrame(rows, MANIFEST + ", base bigint"), "token-index")


def _map(file: str, kind: str, dtype: str) -> np.ndarray:
    files, path = file_system(file)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(f"{path}.{kind}", dtype, "r") if os.path.getsize(f"{path}.{kind}") else np.zeros(0, dtype)
    with files.open_input_file(f"{path}.{kind}") as source:  # a store without memory maps
        return np.frombuffer(source.read(), dtype)


def read_file(file: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, offsets, document ids) of one file, mapped into memory."""
    return _map(file, "ids", f"<u{width}"), _map(file, "off", "<u8").astype(np.int64), _map(file, "doc", "<i8")


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, offsets, docs = read_file(r["file"], r["width"])
            for first in range(0, len(docs), 4096):
                cut = offsets[first:first + 4097]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                known = np.arange(first, first + len(crc)) >= r["null_ids"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs[first:first + 4096], pa.int64(), mask=~known), pa.array(cut[:-1] + r["base"]), pa.array(np.diff(cut)),
                    pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    return manifest.repartition(max(1, manifest.count())).mapInArrow(_read_parts, ROWS)


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, end_id))
