import random
import zlib

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, fp int, label string, key string, tag string, root int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies, a hot
    source and group, white space of all kinds, ids of both signs."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 2, 3, 40, 120])) for _ in range(40)]
    shared = prose(rng, 60)
    texts = [*base, *[base[3]] * 20, None, None, "", "", " ", "\t\n", "\x0b \x0c", "é ü ß", "a b c", "x" * 5000, prose(rng, 20_000)]
    texts += [shared + " " + prose(rng, 30) for _ in range(8)] + [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 5) for _ in range(5)]
    texts += [base[5] + " tail", base[5].upper(), base[5].replace(" ", "  "), "same word " * 100, "a " * 80, "a\x00b <|endoftext|> ▁ <s>"]
    rows = []
    for i, t in enumerate(texts):
        source = [None, "hot", "hot", "hot", "b", "é", "Z", ""][zlib.crc32(str(i).encode()) % 8]
        rows.append((i - 3, t, None if i % 7 == 0 else "en", source, None, i, "s", 1, None, "k", "t", 2))
    return rows + [rows[3]] * 4 + [(None, "no id at all", *rows[0][2:]), (None, None, *rows[0][2:]), (5, "another text of an id in use", *rows[1][2:])]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
