"""Phrases: whole-word occurrences of terms of one or many words, the longest winning at a place.

Two ways with one result. A dictionary of up to ``AUTOMATON_BYTES`` is broadcast and becomes an automaton
over words (Aho and Corasick), built once per Python worker; a text is read once, however many terms there
are, and nothing is shuffled. A larger one meets the texts by the rarest run of up to three words of each
term, counted over these texts, in a salted join: a term that begins with a frequent word does not call up
every text with that word. What is found travels back to its text and is verified there.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.tables import BROADCAST_ROWS, cut, lookup
from veilspan.functions.text import WORD_CHAR
from veilspan.operators.words import OCCURRENCE, TERM, _verified, explode_runs, keyed_by_rarest, run_bits, run_places

#: Bytes of terms up to which a dictionary becomes an automaton; it takes some 50 times that in a worker.
AUTOMATON_BYTES = 4 << 20
_WORD = re.compile(f"[{WORD_CHAR}]+")
_IS_WORD = re.compile(f"[{WORD_CHAR}]")
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("term", pa.string()),
                            ("payload", pa.map_(pa.string(), pa.string()))]))


def leftmost_longest(spans: list[tuple[int, int]]) -> list[int]:
    """Places in ``spans`` (start, end) of those kept: from the left, the longest of a start, none that
    begins inside one kept before."""
    kept, free = [], 0
    for start, minus_end, k in sorted((s, -e, k) for k, (s, e) in enumerate(spans)):
        if start >= free:
            kept.append(k)
            free = -minus_end
    return kept


class PhraseAutomaton:
    """Of terms (term, any case, payload); a hit costs the words read and the hits that end there."""

    def __init__(self, terms: list[tuple[str, bool, dict | None]]):
        self.terms = terms
        self.go: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, int]]] = [[]]
        for k, (term, _, _) in enumerate(terms):
            found = list(_WORD.finditer(term))
            node = 0
            for m in found:
                node = self.go[node].setdefault(m.group().lower(), len(self.go))
                if node == len(self.go):
                    self.go.append({})
                    self.ends.append([])
            if found:
                self.ends[node].append((k, len(found), found[0].start()))
        self.fail = [0] * len(self.go)
        self.shorter = [0] * len(self.go)  # the next node on the way of failures at which a term ends
        waiting = deque(self.go[0].values())
        while waiting:
            node = waiting.popleft()
            for word, below in self.go[node].items():
                back = self.fail[node]
                while back and word not in self.go[back]:
                    back = self.fail[back]
                self.fail[below] = self.go[back].get(word, 0) if node else 0
                self.shorter[below] = self.fail[below] if self.ends[self.fail[below]] else self.shorter[self.fail[below]]
                waiting.append(below)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number of the term)."""
        out, node, starts = [], 0, []
        for m in _WORD.finditer(text):
            word = m.group().lower()
            starts.append(m.start())
            while node and word not in self.go[node]:
                node = self.fail[node]
            node = self.go[node].get(word, 0)
            ending = node if self.ends[node] else self.shorter[node]
            while ending:
                for k, n, lead in self.ends[ending]:
                    term, any_case, _ = self.terms[k]
                    start = starts[-n] - lead
                    end = start + len(term)
                    same = start >= 0 and (text[start:end] == term or any_case and text[start:end].lower() == term.lower())
                    if same and not _IS_WORD.match(text[end:end + 1]) and not (start and _IS_WORD.match(text[start - 1])):
                        out.append((start, end, k))
                ending = self.shorter[ending]
        return out


_BUILT: dict[str, PhraseAutomaton] = {}


def _by_automaton(docs: DataFrame, text: str, terms: list[tuple], out: str, longest: bool) -> DataFrame:
    sent, mark = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    @F.arrow_udf(f"array<{OCCURRENCE}>")
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if mark not in _BUILT:  # a worker serves many tasks
            _BUILT.clear()
            _BUILT[mark] = PhraseAutomaton(sent.value)
        automaton = _BUILT[mark]
        for batch in texts:
            rows = []
            for each in batch:
                value = each.as_py()
                found = sorted(automaton.find(value)) if value else []
                if longest:
                    found = [found[k] for k in leftmost_longest([f[:2] for f in found])]
                rows.append([{"start": s, "end": e, "text": value[s:e], "term": automaton.terms[k][0], "payload": list((automaton.terms[k][2] or {}).items())}
                             for s, e, k in found])
            yield pa.array(rows, FOUND)

    return docs.withColumn(out, search(F.col(text)))


def _kept(spans: Column) -> Column:
    def places(batch: pa.Array) -> pa.Array:
        return pa.array([leftmost_longest([(s["start"], s["end"]) for s in row]) for row in batch.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(places, "array<int>")(spans)


def with_phrases(docs: DataFrame, terms: DataFrame, out: str = "occurrences", doc_id: str = "doc_id", text: str = "text",
                 longest: bool = True, automaton_bytes: int = AUTOMATON_BYTES, broadcast_limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` plus the occurrences of ``terms(term[, ci][, payload])``, in order of their place; without
    ``longest`` overlapping ones too. A term without a letter or digit is never found; of equal terms with
    different payloads one counts. The join needs a unique ``doc_id``."""
    if "ci" not in terms.columns:
        terms = terms.withColumn("ci", F.lit(False))
    if "payload" not in terms.columns:
        terms = terms.withColumn("payload", F.create_map().cast("map<string,string>"))
    terms = terms.where(F.regexp_like("term", F.lit(f"[{WORD_CHAR}]"))).groupBy("term", "ci").agg(F.any_value("payload").alias("payload"))
    if (terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) <= automaton_bytes:
        return _by_automaton(docs, text, [(r["term"], r["ci"], r["payload"]) for r in terms.orderBy("term", "ci").collect()], out, longest)
    places = cut(run_places(terms))
    sizes = sorted(r["size"] for r in places.select("size").distinct().collect())  # at most RUN rows
    # one reading of the texts: what may be a run of a term, for counting and for the join
    tokens = cut(explode_runs(docs, sizes, doc_id, text, bits=run_bits(places.select("first"))))
    counts = tokens.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    keyed = keyed_by_rarest(terms, places, counts).drop("size")
    candidates = lookup(tokens, keyed, ["first"], F.struct(doc_id, "start"), "inner", broadcast_limit)
    per_doc = candidates.groupBy(doc_id).agg(F.collect_list(F.struct("start", "entry")).alias("_cands"))
    none = F.array().cast(f"array<struct<start:int,entry:{TERM}>>")
    found = docs.join(per_doc, doc_id, "left").withColumn("_found", _verified(F.col(text), F.coalesce("_cands", none)))
    found = found.withColumn("_found", _in_order(F.col("_found")))
    if longest:
        found = found.withColumn("_kept", _kept(F.transform("_found", lambda o: F.struct(o["start"], o["end"])))).withColumn(
            "_found", F.transform("_kept", lambda k: F.get("_found", k))).drop("_kept")
    return found.withColumnRenamed("_found", out).drop("_cands")


def _in_order(found: Column) -> Column:
    def order(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).when(
            a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0)

    return F.array_sort(found, order)
