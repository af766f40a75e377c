"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned first: words and beginnings of words that toxic documents have far more often, by
the z value of their log odds over documents that have them; each labelled document counts a term once. A
few general insults are known beforehand, for tables with hardly any labels. Features are densities of
lexicon hits, also near a second person, in capitals or found only after digits and signs are read as
letters; shares of capitals and punctuation; rates of stretched, spaced and mixed words; and lengths.
Spark ML fits the trees, and an isotonic regression on labelled documents that neither the lexicon nor
the trees have seen.

Learning uses all labelled documents up to ``TEACH``, beyond that a share of them by hash of their ids.
The labels used are broadcast, which that bound allows, so no text is shuffled. The lexicon has at most
``LEXICON`` entries. Scores are given to whole texts of all documents; only the text is an input.

Null texts count as empty; an empty text has the features of one and gets a score like any other. Rows
without a label or id do not teach; of several labels of an id the largest counts, and each row of that
id teaches. Without any label every score is 0.5; with one class only, it is 0 or 1. Where the rows kept
for calibration lack a class, scores are the probabilities of the trees.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import stored, text_slices

#: Labelled documents that teach, entries of the lexicon, z value and documents that an entry needs.
TEACH, LEXICON, Z_LEAST, SEEN_LEAST, SEED = 1 << 18, 5_000, 3.0, 3, 53
BEGINNINGS = range(3, 9)
TREES, DEPTH, STEP, FOLDS = 24, 3, 0.3, 4
NEAR = 5
SLICE_BYTES, CACHE, FLUSH = 1 << 20, 200_000, 300_000

INSULTS = frozenset("""
idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown liar coward jerk imbecile
idioten dumm dummkopf blöd trottel abschaum versager widerlich feigling lügner
imbécile crétin débile abruti ordure salaud pourriture minable
imbécil estúpido estúpida basura escoria asqueroso inútil cobarde tonto tonta
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros
""".split())
LOOKALIKES = str.maketrans("013457@$!|€", "oieastasiie")
STRETCHED = re.compile(r"(.)\1{2,}")
#: Bits of a word's code; above them the weight of its lexicon entry, of 255.
LEARNED, KNOWN, YOU, SHOUTED, MIXED, HIDDEN, LONG_DRAWN, SINGLE = (1 << k for k in range(8))
FEATURES = 22


def normal_forms(word: str) -> tuple[str, str]:
    """The lower-case word without signs at its ends, and as it reads with lookalikes taken for letters,
    inner signs left out and drawn-out letters shortened."""
    low = word.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    inner = low[a:b]
    if a and low[a - 1] in "$@€":  # a letter more likely than punctuation
        a -= 1
    elif inner.isalpha():
        return inner, STRETCHED.sub(r"\1", inner) if STRETCHED.search(inner) else inner
    if not any(c.isalpha() for c in low):
        return inner, inner
    read = "".join(c for c in low[a:b].translate(LOOKALIKES) if c.isalpha())
    return inner, STRETCHED.sub(r"\1", read)


def terms(word: str) -> list[str]:
    """The word itself, marked by ``$``, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if k < len(word))] if word else []


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents of the partition that have it; the empty term stands for all."""
    counts, known = (Counter(), Counter()), {}

    def out() -> pa.RecordBatch:
        names = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0]))], ["term", "toxic", "clean"])

    for batch in batches:
        labels = batch.column("label").to_pylist()
        for first, part in text_slices(batch, "text", SLICE_BYTES):
            for label, text in zip(labels[first:], part):
                found = {""}
                for word in set(text.split()):
                    of = known.get(word)
                    if of is None:
                        if len(known) >= CACHE:
                            known.clear()
                        of = known[word] = tuple({t for form in normal_forms(word.decode("utf-8", "replace")) for t in terms(form)})
                    found.update(of)
                counts[1 if label else 0].update(found)
            if len(counts[0]) + len(counts[1]) >= FLUSH:
                yield out()
                counts = (Counter(), Counter())
    yield out()


def learn_lexicon(docs: DataFrame, taught: DataFrame) -> dict[str, float]:
    """term -> weight up to 1, from documents with a label."""
    counted = docs.join(F.broadcast(taught), "doc_id").select("text", "label").mapInArrow(_term_counts, "term string, toxic bigint, clean bigint")
    counts = stored(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0 or term = ''"), "terms")
    of_all = counts.where("term = ''").first()
    if of_all is None or not of_all["toxic"]:
        return {}
    odds = (F.log((F.col("toxic") + 0.5) / (of_all["toxic"] - F.col("toxic") + 0.5))
            - F.log((F.col("clean") + 0.5) / (of_all["clean"] - F.col("clean") + 0.5)))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where((F.col("term") != "") & (F.col("toxic") >= SEEN_LEAST)).select("term", odds.alias("odds"), z.alias("z")).where(
        F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "term").limit(LEXICON).collect()
    return {r["term"]: min(1.0, max(0.05, r["odds"] / 8)) for r in best}


class Words:
    """Codes of words by a lexicon, kept for words that come again."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.codes = lexicon, {}
        self.heads = {t[:BEGINNINGS[0]] for t in lexicon}

    def weight(self, form: str) -> float:
        if len(form) >= BEGINNINGS[0] and form[:BEGINNINGS[0]] not in self.heads:
            return 0.0  # all its terms begin so
        return max((self.lexicon.get(t, 0.0) for t in terms(form)), default=0.0)

    def code(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        plain, read = normal_forms(word)
        weight, known, code = self.weight(plain), plain in INSULTS, 0
        if read != plain and not weight and not known:
            weight, known = self.weight(read), read in INSULTS
            code |= HIDDEN if weight or known else 0
        code |= (LEARNED if weight else 0) | (KNOWN if known else 0) | (YOU if plain in SECOND_PERSON else 0)
        code |= (SHOUTED if len(plain) > 1 and word.isupper() else 0) | (SINGLE if len(plain) == 1 and plain.isalpha() else 0)
        code |= (LONG_DRAWN if plain.isalpha() and read != plain else 0) | (MIXED if not plain.isalpha() and read and read != plain else 0)
        return code | int(weight * 255) << 8

    def of(self, words: list[bytes]) -> np.ndarray:
        codes, known = [], self.codes
        for word in words:
            code = known.get(word)
            if code is None:
                if len(known) >= CACHE:
                    known.clear()
                code = known[word] = self.code(word)
            codes.append(code)
        return np.array(codes, np.int64)


_CLASSES = np.zeros((256, 7))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), b"!", b"?", b"#$%&*@^~", b".,;:", range(128, 256))):
    _CLASSES[list(_bytes), _k] = 1.0


def features(text: bytes, coder: Words) -> list[float]:
    words = text.split()
    n, size = len(words) or 1, len(text) or 1
    codes = coder.of(words)
    weights, bits = (codes >> 8) / 255.0, codes & 255
    hit = (bits & (LEARNED | KNOWN)) > 0
    upper, lower, bangs, asks, signs, stops, high = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()
    doubled = text.count(b"!!") + text.count(b"??") + text.count(b"!?") + text.count(b"?!")
    share = [float(np.count_nonzero(bits & flag)) / n for flag in (KNOWN, YOU, SHOUTED, MIXED, HIDDEN, LONG_DRAWN, SINGLE)]
    at, near = np.flatnonzero(hit), 0
    if len(at):
        before = np.concatenate([[0], np.cumsum((bits & YOU) > 0)])
        near = int(np.count_nonzero(before[np.minimum(at + NEAR + 1, len(words))] > before[np.maximum(at - NEAR, 0)]))
    known = np.count_nonzero(bits & KNOWN)
    return [
        float(weights.sum()) / n, float(np.log1p(weights.sum())), float(weights.max()) if words else 0.0, float(np.log1p(known)),
        float(np.count_nonzero(hit & ((bits & SHOUTED) > 0))) / n, near / n, *share,
        upper / (upper + lower + 1), bangs / size, asks / size, signs / size, stops / size, doubled / size, high / size,
        float(np.log1p(len(words))), size / n]


def text_features(lexicon: dict[str, float]) -> Column:
    """Features of the column ``text``. The lexicon is bounded and travels with the function."""

    @F.arrow_udf("array<float>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Words(lexicon)
        for each in texts:
            batch = pa.RecordBatch.from_arrays([each], ["text"])
            yield pa.array([features(t, coder) for _, part in text_slices(batch, "text", SLICE_BYTES) for t in part], pa.list_(pa.float32()))

    return of(F.col("text"))


def teachers(labels: DataFrame) -> DataFrame:
    """(doc_id, label, fold) of at most about ``TEACH`` ids; fold 0 is for calibration."""
    known = stored(labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(
        (F.max("label") > 0).cast("double").alias("label")), "labels")
    rate = TEACH / max(known.count(), TEACH)
    mixed = F.xxhash64("doc_id", F.lit(SEED))
    return known.where(F.pmod(mixed, F.lit(1 << 20)) < rate * (1 << 20)).withColumn("fold", F.pmod(F.shiftrightunsigned(mixed, 24), F.lit(FOLDS)))


def toxicity(docs: DataFrame, labels: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """A score for each row of docs (doc_id, text); labels (doc_id, label 0 or 1). ``carried`` columns of
    docs, by their new names, are returned in front of ``score``."""
    taught = teachers(labels)
    lexicon = learn_lexicon(docs.select("doc_id", "text"), taught.where("fold <> 0"))
    described = stored(docs.select("doc_id", F.struct(*(c.alias(n) for n, c in carried.items())).alias("carried"),
                                   text_features(lexicon).alias("f")), "toxic-features")
    described = described.withColumn("features", array_to_vector("f"))
    known = described.join(F.broadcast(taught), "doc_id").select("features", "label", "fold")
    counts = {(r["kept"], r["label"]): r["n"] for r in known.groupBy((F.col("fold") == 0).alias("kept"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = {label for kept, label in counts if not kept}
    if len(classes) < 2:
        return described.select("carried.*", F.lit(classes.pop() if classes else 0.5).alias("score"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(known.where("fold <> 0"))

    def rated(df: DataFrame) -> DataFrame:
        return trees.transform(df).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))

    out = rated(described)
    if (True, 0.0) in counts and (True, 1.0) in counts:
        fitted = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(rated(known.where("fold = 0")).select("p", "label"))
        out = fitted.transform(out)
    else:
        out = out.withColumn("score", F.col("p"))
    return out.select("carried.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
