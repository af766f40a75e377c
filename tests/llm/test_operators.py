"""The ten operators against plain versions of themselves, on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import line_dedup as lines
from veilspan.llm import near_dedup as near
from veilspan.llm import substring_dedup as sub
from veilspan.llm.common import WORD
from veilspan.llm.decontaminate import contaminated, decontaminate, usable_items
from veilspan.llm.exact_dedup import CuckooFilter, bucket_count, digests, empty_index, exact_dedup, update_index
from veilspan.llm.graph import components
from veilspan.llm.mixing import copies_per_row, mix, plan_copies
from veilspan.llm.quality import document_statistics, fit, good_documents, pool, scores
from veilspan.llm.sharding import SlotMap, positions, shard, slot_loads, with_slot
from veilspan.llm.token_counts import count_tokens
from veilspan.llm.token_files import token_ids

tokenizers = pytest.importorskip("public_tokenizers")
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def key(row):
    return tuple((v is not None, v) for v in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1 token files ------------------------------------------------------------------------------------
def test_token_files(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_ids(spark, odd, path, 1).orderBy("start").collect()]
    ids = {(r[0], r[1]): tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in odd_rows}
    want = sorted(((r[0], len(ids[r[0], r[1]]), zlib.crc32(np.array(ids[r[0], r[1]], "<u4").tobytes())) for r in odd_rows), key=key)
    assert sorted(((i, n, crc) for i, _, n, crc in got), key=key) == want
    assert [g[0] for g in got] == sorted((r[0] for r in odd_rows), key=lambda v: (v is not None, v))
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    assert token_ids(spark, empty, path, 1).count() == 0


# 2 quality ----------------------------------------------------------------------------------------
def test_quality_learns_and_stands_odd_input(spark, odd, odd_rows, empty, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    seen = F.pmod("doc_id", F.lit(4)) != 2
    stats = document_statistics(docs)
    model = fit(stats, labels.where(seen))
    held = stats.withColumn("score", scores(model)).join(labels.where(~seen), "doc_id").select("score", "label").toPandas()
    assert ((held.score >= 0.7) == (held.label == 1)).mean() >= 0.9
    odd_scores = [r[0] for r in document_statistics(odd).select(scores(model)).collect()]
    assert len(odd_scores) == len(odd_rows) and all(0 <= s <= 1 for s in odd_scores)
    none = labels.where("false")
    assert not fit(stats, none).taught and good_documents(odd, none, 0.7).count() == len(odd_rows)
    assert not fit(document_statistics(empty), labels).taught and good_documents(empty, labels, 0.7).columns == empty.columns


def test_pooling_is_isotonic_regression():
    at, value = pool(np.arange(5.0), np.array([1.0, 0, 2, 1, 2]), np.array([2.0, 2, 2, 2, 2]))
    assert value.tolist() == [0.25, 0.75, 1.0] and at.tolist() == [0.5, 2.5, 4.0]


# 3 lines ------------------------------------------------------------------------------------------
def test_fuzzy_lines(spark, odd_rows, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long_line = " ".join(word() for _ in range(60))
    variants = [long_line.replace(long_line.split()[k], long_line.split()[k][:-1] + "z") for k in range(0, 60, 7)]
    page = [f"Page {k} of {k + 9} in our long report" for k in range(12)]
    texts = [r[1] for r in odd_rows] + [f"{a}\n{b}\nshort line\n{b}" for a, b in zip(variants, page)] + ["\n".join(page)]
    table = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, page[0])]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    occurrences, raw = defaultdict(set), sorted(set(table), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in raw:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            plain = lines.normal_line(line)
            if len(plain.split()) >= 5:
                occurrences[plain].add((i is None, i or 0, k))
    kinds = list(occurrences)
    prints = lines.line_rows([k.encode() for k in kinds], 5)[3]
    links = [(i, j) for i in range(len(kinds)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 3
             and lines.alike(kinds[i], kinds[j], 0.8)]
    groups = defaultdict(set)
    for k, c in zip(kinds, classes(len(kinds), links)):
        groups[c] |= occurrences[k]
    gone = defaultdict(set)
    for places in groups.values():
        for none, i, k in sorted(places)[1:]:
            gone[none, i].add(k)
    want = []
    for i, t in table:
        split, out = (t or "").split("\n"), gone[i is None, i or 0]
        want.append((i, "\n".join(x for k, x in enumerate(split) if k not in out), len(split), len(out)))
    assert rows(lines.line_dedup(docs)) == sorted(want, key=key)
    assert links and lines.line_dedup(empty).count() == 0


def test_line_tiles_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(50))
    table = [(i, base[:-4] + "".join(rng.choice("ghij") for _ in range(4))) for i in range(60)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    whole = rows(lines.line_dedup(docs))
    monkeypatch.setattr(lines, "TILE", 7)
    assert rows(lines.line_dedup(docs)) == whole and sum(r[3] for r in whole) > 20


def test_edit_distance():
    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last = _row(last, i, x, b)
        return last[-1]

    def _row(last, i, x, b):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


# 4 mixing -----------------------------------------------------------------------------------------
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 2.0 * sizes[s] for s in capped}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mixing(spark, odd, odd_rows, empty):
    size = lambda t: len(re.findall(WORD, t or ""))
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(sizes)
    plan = plan_copies(odd)
    got = copies_per_row(plan).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=key) == sorted(((r[0], r[3], size(r[1])) for r in odd_rows), key=key)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(size(r[1]) for r in odd_rows if r[3] == s) for s in sizes)
    assert rows(copies_per_row(plan_copies(odd.repartition(7)))) == rows(copies_per_row(plan))
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +sum(
        (Counter({(r.doc_id, r.source): r.copies}) for r in got), Counter())
    assert copies_per_row(plan_copies(empty)).count() == 0 and mix(empty).count() == 0


def test_mixing_tree_keeps_targets(spark):
    from veilspan.llm import mixing

    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'hot') as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    plan = plan_copies(docs).toPandas()
    for _, g in plan.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 50
    rate = plan.groupby("source").agg(c=("copies", "mean"), t=("target", "first"), s=("source_size", "first"))
    assert (abs(rate.c - rate.t / rate.s) < 0.05).all() and mixing.GROUP_ROWS < 4000


# 5 near-dedup -------------------------------------------------------------------------------------
def brute_print(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_groups(spark, odd, odd_rows, empty):
    prints = [brute_print(r[1], 3) for r in odd_rows]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = classes(len(prints), links)
    least = defaultdict(list)
    for r, c in zip(odd_rows, group):
        if r[0] is not None:
            least[c].append(r[0])
    want = [(r[0], p - (1 << 64) if p >> 63 else p, min(least[c], default=None)) for r, p, c in zip(odd_rows, prints, group)]
    assert rows(near.near_groups(odd, 3, 2).select("doc_id", "fp", "component_id")) == sorted(want, key=key)
    kept = near.near_dedup(odd, 3, 2)
    assert kept.columns == odd.columns and kept.count() == len(set(group))
    assert near.near_groups(empty).count() == 0 and near.near_dedup(empty).count() == 0


@pytest.mark.parametrize("bits", [2, 4])
def test_vantage_trees_lose_no_pair(spark, bits):
    rng = np.random.default_rng(bits)
    points = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for flips in range(1, bits + 1):
        flipped = points[:250].copy()
        for _ in range(flips):
            flipped ^= np.uint64(1) << rng.integers(0, 64, 250, dtype=np.uint64)
        points = np.concatenate([points, flipped])
    points = np.unique(points)
    near_to = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
    want = classes(len(points), [(int(a), int(b)) for a, b in zip(*np.nonzero(near_to)) if a < b])
    assert near.link(points, bits).tolist() == want
    prints = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in components(near.fingerprint_links(prints, bits)).collect()}
    signed = points.view(np.int64)
    by_class = defaultdict(list)
    for p, c in zip(signed.tolist(), want):
        by_class[c].append(p)
    assert got == {p: min(g) for g in by_class.values() if len(g) > 1 for p in g if p != min(g)} | {
        p: min(g) for g in by_class.values() if len(g) > 1 for p in g if p in got}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[k] == 1000 for k in range(1001, 1400))


# 6 sharding ---------------------------------------------------------------------------------------
def test_sharding(spark, odd, odd_rows, empty, tmp_path):
    got = positions(odd, 4).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows), key=key)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == want
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    even = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 300 as int)) as text")
    sums = [r[0] for r in positions(even, 7).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 7 and max(sums) <= 1.01 * min(sums)
    placed, slot_map = shard(odd, 4)
    assert placed.columns == [*odd.columns, "virtual_slot", "shard_2"] and dict(placed.dtypes)["shard_2"] == "int" and placed.count() == len(odd_rows)
    slot_map.save(spark, str(tmp_path))
    assert SlotMap.load(spark, str(tmp_path), 1) == slot_map
    assert positions(empty, 3).count() == 0 and shard(empty, 3)[0].count() == 0


def test_rebalancing_only_fills_the_new_shard(spark):
    even = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 300 as int)) as text")
    loads, _ = slot_loads(with_slot(even))
    before = shard(even, 5)[1]
    after = before.grow(loads)
    assert after.version == 2 and all(a == b or a == 5 for a, b in zip(after.shard_of, before.shard_of))
    sums = Counter()
    for slot, s in enumerate(after.shard_of):
        sums[s] += loads[slot]
    assert max(sums.values()) <= 1.05 * min(sums.values())


def test_a_stored_map_is_edited(spark, tmp_path):
    """A later job with more shards loads the map and edits it: only the new shards take rows."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 300 as int)) as text")
    at = lambda shards: {r.doc_id: r.shard for r in shard(docs, shards, root=f"{tmp_path}/map")[0].collect()}
    five, again, seven = at(5), at(5), at(7)
    assert five == again and {s for i, s in seven.items() if s != five[i]} == {5, 6}
    assert SlotMap.load(spark, f"{tmp_path}/map", 3).shards == 7 and SlotMap.load(spark, f"{tmp_path}/map", 1).shards == 5
    assert {r.doc_id: r.shard for r in positions(docs, 7, root=f"{tmp_path}/map").collect()} == seven
    with pytest.raises(ValueError):
        at(6)


# 7 token counts -----------------------------------------------------------------------------------
def test_token_counts(spark, odd, odd_rows, empty):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["  a  b ", " ", "   ", "a ▁ b", "x ▁", "a \n b", "\n", "tail ", " head", "１２ ３"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more)), "doc_id bigint, text string"))
    want = [(i, t, len(model.encode(t or ""))) for i, t in [(r[0], r[1]) for r in odd_rows] + list(enumerate(more))]
    assert rows(count_tokens(docs, path)) == sorted(want, key=key)
    assert count_tokens(empty, path).count() == 0


# 8 decontamination --------------------------------------------------------------------------------
def nearest_stretch(item, words):
    """Smallest number of word edits between the item and any stretch of the text, row by row."""
    above = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        row = [i]
        for j, y in enumerate(words, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("klmnop") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (8, 12, 20, 33, 70, 3)]

    def edited(item, n):
        item = list(item)
        for _ in range(n):
            at = rng.randrange(len(item))
            item[at:at + 1] = rng.choice([[], ["zzz"], [item[at], "yyy"]])
        return item

    table, doc = [], 0
    for item in items:
        for n in (0, 1, len(item) // 5, len(item) // 5 + 3, len(item) // 2):
            words = [word() for _ in range(rng.randint(0, 80))] + edited(item, n) + [word() for _ in range(rng.randint(0, 80))]
            table.append((doc, " ".join(w.upper() + "!" if n % 2 else w for w in words)))
            doc += 1
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, ""), (0, " ".join(items[0]))], "item_id bigint, text string")
    docs = spark.createDataFrame(table + [(None, table[0][1]), (100, None), (101, "")], "doc_id bigint, text string")
    want = []
    for i, t in table + [(None, table[0][1])]:
        words = [w.lower().strip("!") for w in t.split()]
        for k, item in enumerate(items):
            d = nearest_stretch(item, words)
            if d <= (len(item) // 5 if len(item) >= 8 else 0):
                want.append((i, k, d, len(item)))
    got = contaminated(docs, benchmark)
    assert sorted({tuple(r)[:4] for r in got.collect()}, key=key) == sorted(want, key=key) and len(want) >= 15
    clean = decontaminate(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in table} - {w[0] for w in want} | {100, 101}
    assert decontaminate(odd, benchmark).columns == odd.columns
    assert contaminated(empty, benchmark).count() == 0 and contaminated(docs, benchmark.where("false")).count() == 0
    assert [r.item_id for r in usable_items(benchmark).where("not usable").orderBy("item_id").collect()] == [90, 91]


def test_decontamination_without_blanks(spark):
    """In scripts without blanks characters are words, so an item is found within a sentence, edits too."""
    item = "今日はとても良い天気ですねと彼女は言いました"
    texts = [f"前の文。{item}。後の文", item.replace("良", "悪"), "今日は雨", f"abc{item[:4]} {item[4:]}xyz", "สวัสดีชาวโลก"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    benchmark = spark.createDataFrame([(1, item), (2, "ชาว"), (3, "---"), (4, "Abc")], "item_id int, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in contaminated(docs, benchmark).collect()} == {(0, 1, 0), (1, 1, 1), (3, 1, 0), (3, 4, 0), (4, 2, 0)}
    assert [r.doc_id for r in decontaminate(docs, benchmark).collect()] == [2]


# 9 substrings -------------------------------------------------------------------------------------
@pytest.mark.parametrize("full", [64, 1])
def test_substrings(spark, odd, odd_rows, empty, monkeypatch, full):
    monkeypatch.setattr(sub, "FULL", full)
    split = [(r[0], (r[1] or "").encode().split()) for r in odd_rows]
    seen = Counter(tuple(w[k:k + 35]) for _, w in split for k in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert rows(sub.substring_dedup(odd)) == sorted(want, key=key) and sum(w[2] for w in want) > 1000
    digest = rows(sub.substring_dedup(odd, digest=True))
    assert digest == sorted(((*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want), key=key)
    assert sub.substring_dedup(empty).count() == 0


# 10 exact dedup -----------------------------------------------------------------------------------
def test_exact_dedup(spark, odd, odd_rows, empty):
    group = defaultdict(list)
    for r in odd_rows:
        group[BLANK.sub(" ", r[1] or "")].append(r[0])
    want = []
    for text, ids in group.items():
        known, digest = [i for i in ids if i is not None], hashlib.sha256(text.encode()).digest()
        keep, first = min(known, default=None), True
        for i in ids:
            want.append((i, digest, keep, len(ids), i == keep and first))
            first = first and i != keep
    got = [(a, bytes(b), c, d, e) for a, b, c, d, e in (tuple(r) for r in exact_dedup(odd).collect())]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert exact_dedup(empty).count() == 0


def test_index_takes_batches_in_and_out(spark, odd):
    read = digests(odd)
    whole = update_index(empty_index(spark), read, bucket_count(1))
    half = update_index(empty_index(spark), read.where("doc_id < 30"), bucket_count(1))
    both = update_index(half, read.where("doc_id >= 30 or doc_id is null"), bucket_count(1))
    content = lambda index: rows(index.where("digest is not null").select("digest", "keep_id", "group_size"))
    assert content(both) == content(whole)
    back = update_index(both, read.where("doc_id >= 30 or doc_id is null"), bucket_count(1), live=False)
    assert [(r[0], r[2]) for r in content(back)] == [(r[0], r[2]) for r in content(half)]
    left = read.where("doc_id < 30")
    assert content(update_index(both, read.where("doc_id >= 30 or doc_id is null"), bucket_count(1), live=False, left=left)) == content(half)


def test_smallest_id_after_a_deletion(spark):
    """The row that names a group goes: the smallest that is left names it; groups without rows go, others stay."""
    read = digests(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c"), (6, "c")], "doc_id int, text string"))
    index = update_index(empty_index(spark), read, bucket_count(1))
    after = update_index(index, read.where("doc_id in (1, 4, 6)"), bucket_count(1), live=False, left=read.where("doc_id in (2, 3, 5)"))
    assert sorted((r.keep_id, r.group_size) for r in after.where("digest is not null").collect()) == [(2, 2), (5, 1)]
    again = update_index(after, read.where("doc_id in (1, 4)"), bucket_count(1))
    assert sorted((r.keep_id, r.group_size) for r in again.where("digest is not null").collect()) == [(1, 3), (4, 1), (5, 1)]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 3500, dtype=np.uint64)
    cuckoo = CuckooFilter(1024)
    for part in np.array_split(hashes, 9):
        cuckoo.insert(part)
    assert cuckoo.contains(hashes).all() and np.count_nonzero(cuckoo.cells) == len(hashes)
    cuckoo.delete(hashes[:1000])
    assert cuckoo.contains(hashes[1000:]).all() and np.count_nonzero(cuckoo.cells) == 2500
    assert cuckoo.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001
