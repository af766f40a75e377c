"""Words of texts and whole-word occurrences of many terms in many texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.regex import hits, let
from veilspan.functions.tables import BROADCAST_ROWS, at_most, cut, lookup
from veilspan.functions.text import WORD_CHAR

# Up to this many terms the dictionary becomes a literal and the whole search stays in the row.
INLINE_TERMS = 2_000
# Words in a row that a term and a text have to share before the term is looked at.
RUN = 3
TERM = "struct<term:string,lead:int,n:int,ci:boolean,payload:map<string,string>>"
OCCURRENCE = "struct<start:int,end:int,text:string,term:string,payload:map<string,string>>"
OCCURRENCES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("term", pa.string()),
                                  ("payload", pa.map_(pa.string(), pa.string()))]))
# Bits that tell which runs of words may be a term's: 4 MB for any dictionary. More terms let more other runs
# pass, which the join drops. A run's place is the sum of its words' checksums times these factors.
BITS, FACTORS = 1 << 25, (1, 40_503, 34_283)
WORD = re.compile(f"[{WORD_CHAR}]+")
_IS_WORD = re.compile(f"[{WORD_CHAR}]")


def segments(text: Column) -> Column:
    """ARRAY<STRUCT<start, text>>: pieces of about 500 characters that never cut a word."""
    pattern = F.lit(rf"(?s).{{0,511}}[^{WORD_CHAR}]|[{WORD_CHAR}]++")
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        return F.struct(
            (acc["pos"] + F.length(piece)).cast("int").alias("pos"),
            F.array_append(acc["out"], F.struct(acc["pos"].alias("start"), piece.alias("text"))).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, pattern, F.lit(0)), zero, step, lambda a: a["out"])


def words(text: Column, escapes: bool = False) -> Column:
    """ARRAY<STRUCT<start, word>> of all words. With ``escapes`` a word behind a backslash that starts
    with n, r or t also counts without that letter (``\\nHost`` in escaped text)."""
    def in_segment(s: Column) -> Column:
        located = hits(s["text"], f"[{WORD_CHAR}]+", before=1 if escapes else 0)
        if not escapes:
            return F.transform(located, lambda h: F.struct(
                (s["start"] + h["start"]).cast("int").alias("start"), h["text"].alias("word")))
        return let(F.transform(located, lambda h: F.struct(
            (s["start"] + h["start"]).cast("int").alias("start"), h["text"].alias("word"), h["before"].alias("b"))), with_escapes)

    def with_escapes(found: Column) -> Column:
        plain = F.transform(found, lambda h: F.struct(h["start"], h["word"]))
        behind = F.filter(found, lambda h: (h["b"] == "\\") & F.regexp_like(h["word"], F.lit("^[nrt].")))
        return F.concat(plain, F.transform(behind, lambda h: F.struct(
            (h["start"] + 1).cast("int").alias("start"), F.substring(h["word"], F.lit(2), F.length(h["word"])).alias("word"))))

    return F.flatten(F.transform(segments(text), in_segment))


def explode_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", escapes: bool = False) -> DataFrame:
    """(doc_id, start, word), without the text. (An outer generator is evaluated once; for the others
    Catalyst adds tests of the array below them, which evaluate it again.)"""
    return docs.select(doc_id, F.inline_outer(words(F.col(text), escapes))).where(F.col("start").isNotNull())


class _Checksums(dict):
    """Checksum of a word in lower case; a worker meets the same words again and again."""

    LARGEST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LARGEST:
            self.clear()
        value = self[word] = zlib.crc32(word.lower().encode())
        return value


_CHECKSUMS = _Checksums()


def run_bits(keys: DataFrame) -> bytes:
    """A bit per place that a run in ``keys(first)`` has; the tables of bits are built by the tasks."""
    parts = F.transform(F.split("first", " "), lambda w, i: F.crc32(F.encode(w, "UTF-8")) * F.element_at(F.array(*[F.lit(f).cast("bigint") for f in FACTORS]), i + 1))
    place = F.pmod(F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(BITS)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(BITS // 8)
    for row in rows.toLocalIterator():
        out[(row["b"] - 1) * 4096:row["b"] * 4096] = row["bits"]
    return bytes(out)


def runs_in(text: str, sizes: list[int], escapes: bool = False, bits: np.ndarray | None = None) -> list[tuple[int, str]]:
    """(start, lower-case words joined by blanks) of the runs of ``sizes`` words; with ``bits`` only those that may be a key."""
    found = WORD.findall(text)
    sums = np.fromiter(map(_CHECKSUMS.__getitem__, found), np.int64, len(found))
    starts: list[int] = []
    out = []

    def passed(places: np.ndarray) -> np.ndarray:
        places = places & (BITS - 1)
        return np.ones(len(places), bool) if bits is None else (bits[places >> 3] >> (places & 7) & 1).astype(bool)

    def rest_of(n: int) -> np.ndarray:
        total = np.zeros(max(len(found) - n + 1, 0), np.int64)
        for k in range(1, n):
            total += sums[k:len(found) - n + 1 + k] * FACTORS[k]
        return total

    turned = escapes and "\\" in text
    for n in sizes:
        rest = rest_of(n)
        taken = [(int(i), 0) for i in np.flatnonzero(passed(rest + sums[:len(rest)]))]
        if (taken or turned) and not starts:
            starts = [m.start() for m in WORD.finditer(text)]
        if turned:
            short = [i for i in range(len(rest)) if starts[i] and text[starts[i] - 1] == "\\" and len(found[i]) > 1 and found[i][0] in "nrt"]
            first = np.fromiter((_CHECKSUMS[found[i][1:]] for i in short), np.int64, len(short))
            taken += [(i, 1) for i, ok in zip(short, passed(rest[short] + first)) if ok]
        out += [(starts[i] + cut_, " ".join([found[i][cut_:], *found[i + 1:i + n]]).lower()) for i, cut_ in taken]
    return out


def explode_runs(docs: DataFrame, sizes: list[int], doc_id: str = "doc_id", text: str = "text", escapes: bool = False,
                 bits: bytes | None = None) -> DataFrame:
    """(doc_id, start, first): the lower-case words of every run of ``sizes`` (1 to ``RUN``) words, joined by
    blanks. With ``escapes`` a run may also begin with its first word without an escape's letter. With ``bits`` (of
    ``run_bits``) only runs that may be one of these keys, so other words of the texts do not travel."""
    sent = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("first", pa.string())]))

    @F.arrow_udf("array<struct<start:int,first:string>>")
    def runs(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = None if sent is None else np.frombuffer(sent.value, np.uint8)
        for batch in texts:
            yield pa.array([[] if not t else [{"start": s, "first": f} for s, f in runs_in(t, sizes, escapes, table)] for t in batch.to_pylist()], kind)

    return docs.select(doc_id, F.inline_outer(runs(F.col(text)))).where(F.col("first").isNotNull())


def context_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-case words of three and more letters: values a surrogate must not take."""
    pieces = docs.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(
        F.lower(F.col(text)), F.lit("[a-zà-ɏ]{3,}"), F.lit(0)))).alias("surrogate"))
    return pieces.where(F.col("surrogate").isNotNull()).distinct()


def _with_defaults(terms: DataFrame) -> DataFrame:
    if "ci" not in terms.columns:
        terms = terms.withColumn("ci", F.lit(False))
    if "payload" not in terms.columns:
        terms = terms.withColumn("payload", F.create_map().cast("map<string,string>"))
    return terms


def prepare_terms(terms: DataFrame) -> DataFrame:
    """(first, entry): terms keyed by their first word. Input: ``term``, optional ``ci`` (match in any
    case) and ``payload`` (MAP). Terms need at least one letter or digit."""
    terms = _with_defaults(terms)
    first = F.regexp_extract("term", f"[{WORD_CHAR}]+", 0)
    lead = F.length(F.regexp_extract("term", f"^([^{WORD_CHAR}]*)", 1))
    entry = F.struct("term", lead.cast("int").alias("lead"), F.length("term").cast("int").alias("n"), "ci", "payload")
    return terms.where(first != "").select(F.lower(first).alias("first"), entry.cast(TERM).alias("entry"))


def run_places(terms: DataFrame) -> DataFrame:
    """(term, ci, first, size, lead): the runs of up to ``RUN`` words of every term, and where in it they begin."""
    def runs(found: Column) -> Column:
        size = F.least(F.size(found), F.lit(RUN))
        return F.transform(F.sequence(F.lit(0), F.size(found) - size), lambda i: F.struct(
            F.lower(F.array_join(F.transform(F.slice(found, i + 1, size), lambda w: w["word"]), " ")).alias("first"),
            size.alias("size"), F.get(found, i)["start"].alias("lead")))

    return terms.select("term", "ci").distinct().select("term", "ci", F.inline_outer(let(words(F.col("term")), runs)))


def keyed_by_rarest(terms: DataFrame, places: DataFrame, counts: DataFrame) -> DataFrame:
    """(first, size, entry): each term under the one of its runs that ``counts(first, n)`` has least often."""
    best = lookup(places, counts, ["first"], F.struct("term", "ci")).groupBy("term", "ci").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "lead", "first", "size")).alias("k"))
    entry = F.struct("term", F.col("k.lead").alias("lead"), F.length("term").cast("int").alias("n"), "ci", "payload")
    return terms.join(best, ["term", "ci"]).select(F.col("k.first").alias("first"), F.col("k.size").alias("size"), entry.cast(TERM).alias("entry"))


def terms_by_run(terms: DataFrame) -> DataFrame:
    """(first, size, entry): terms keyed by the run of up to ``RUN`` words that the fewest terms have, so that
    terms which begin alike (``REF-``, ``+1``, one first name) do not all meet every text with that beginning."""
    terms = _with_defaults(terms).where(F.regexp_like("term", F.lit(f"[{WORD_CHAR}]")))
    places = run_places(terms)
    return keyed_by_rarest(terms, places, places.groupBy("first").agg(F.count(F.lit(1)).alias("n")))


def _occurrence(text: str, start: int, entry: dict) -> dict | None:
    """The whole-word occurrence of a term whose key begins at ``start`` of the text, or None."""
    begin = start - entry["lead"]
    end, term = begin + entry["n"], entry["term"]
    if begin < 0:
        return None
    value = text[begin:end]
    if value != term and not (entry["ci"] and value.lower() == term.lower()):
        return None
    # two characters in front are enough: a word character, or the end of an escape
    if begin and _IS_WORD.match(text[begin - 1]) and not (begin > 1 and text[begin - 2] == "\\" and text[begin - 1] in "nrt"):
        return None
    if _IS_WORD.match(text[end:end + 1]):
        return None
    return {"start": begin, "end": end, "text": value, "term": term, "payload": entry["payload"]}


def _verified(text: Column, candidates: Column) -> Column:
    """Candidates (word start, entry) that are whole-word occurrences of their term."""
    def check(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for value, each in zip(texts.to_pylist(), found.to_pylist()):
            placed = [] if value is None else [_occurrence(value, c["start"], c["entry"]) for c in each or ()]
            rows.append([o for o in placed if o])
        return pa.array(rows, OCCURRENCES)

    return F.arrow_udf(check, f"array<{OCCURRENCE}>")(text, candidates)


def with_occurrences(docs: DataFrame, terms: DataFrame, out: str = "occurrences", doc_id: str = "doc_id",
                     text: str = "text", escapes: bool = False, inline_limit: int = INLINE_TERMS,
                     broadcast_limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` plus all whole-word occurrences of ``terms`` (overlapping ones too).

    A small dictionary goes to every worker: no shuffle, no explode. Otherwise the runs of words that may be a
    term's key meet the terms on the rarest run of each term (broadcast if the terms are few enough, else a
    salted shuffle that spreads frequent words), and only the hits travel back to their texts.
    """
    prepared = prepare_terms(terms)
    if at_most(prepared, inline_limit):
        return docs.withColumn(out, _inline(F.col(text), prepared, escapes))
    keyed = cut(terms_by_run(terms))
    sizes = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # at most RUN rows
    if not sizes:
        return docs.withColumn(out, F.array().cast(f"array<{OCCURRENCE}>"))
    tokens = explode_runs(docs, sizes, doc_id, text, escapes, run_bits(keyed.select("first")))
    candidates = lookup(tokens, keyed.drop("size"), ["first"], F.struct(doc_id, "start"), "inner", broadcast_limit)
    per_doc = candidates.groupBy(doc_id).agg(F.collect_list(F.struct("start", "entry")).alias("_cands"))
    joined = docs.join(per_doc, doc_id, "left")
    none = F.array().cast(f"array<struct<start:int,entry:{TERM}>>")
    return joined.withColumn(out, _verified(F.col(text), F.coalesce("_cands", none))).drop("_cands")


def _inline(text: Column, prepared: DataFrame, escapes: bool) -> Column:
    """The search with the dictionary in the function (at most ``INLINE_TERMS`` rows are collected)."""
    table: dict[str, list] = {}
    for row in prepared.collect():
        entry = row["entry"].asDict()
        table.setdefault(row["first"], []).append({**entry, "payload": list((entry["payload"] or {}).items())})
    if not table:
        return F.array().cast(f"array<{OCCURRENCE}>")

    def of_text(value: str) -> list[dict]:
        out = []
        for m in WORD.finditer(value):
            start, word = m.start(), m.group()
            places = [(start, word)]
            if escapes and start and value[start - 1] == "\\" and len(word) > 1 and word[0] in "nrt":
                places.append((start + 1, word[1:]))
            for at, key in places:
                out += [o for e in table.get(key.lower(), ()) if (o := _occurrence(value, at, e))]
        return out

    def search(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of_text(t) for t in texts.to_pylist()], OCCURRENCES)

    return F.arrow_udf(search, f"array<{OCCURRENCE}>")(text)
