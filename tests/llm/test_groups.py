"""Near-duplicates, shards and neighbours against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm.components import components
from tabweave.llm.sharding import bundled, combine, difference, shard_documents
from tabweave.llm.simhash import fingerprint, hex_fingerprint, keep_one, links, near_duplicates, ring
from tabweave.llm.va_topk import top_k

from .helpers import documents, nothing


def joined(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (300, 301), (301, 300)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == joined(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("radius", "light"), [(2, 8), (2, 64), (2, 10**6), (1, 8), (4, 64)])
def test_links_are_all_pairs_within_the_radius(spark, radius, light):
    rng = random.Random(3)
    found = {0, (1 << 64) - 1}
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    dense = rng.getrandbits(64)  # all of 2^7 that differ in seven bits alone, which stay crowded for long
    found |= {dense ^ sum((k >> i & 1) << 9 * i for i in range(7)) for k in range(128)}
    found = sorted(found)
    pairs = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(found) for b in found[:i] if (a ^ b).bit_count() <= radius}
    df = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    assert {(r.a, r.b) for r in links(df, radius, light).collect()} == pairs
    assert sum(ring(radius)) == (1 << 64) - 1 and sum(ring(radius, 0xF0F)) == 0xF0F


def near(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(spark):
    docs = documents(spark)
    got = near_duplicates(docs).withColumn("hex", hex_fingerprint(F.col("fp"))).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.hex) for r in got) == sorted((str(r.doc_id), f"{near(r.text):016x}") for r in rows)
    assert all(fingerprint(r.text and r.text.encode()) == near(r.text) for r in rows)
    fps = {near(r.text) for r in rows}
    classes = joined(fps, [(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2])
    first = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            first[classes[near(r.text)]].append(r.doc_id)
    for r in got:
        assert r.component_id == min(first[classes[r.fp & ((1 << 64) - 1)]], default=None)
    assert near_duplicates(nothing(spark)).count() == 0


def test_keep_one(spark):
    docs = documents(spark, [(1, "a b c d"), (2, "a b c d"), (3, "other words here"), (3, "other words here"), (None, "nameless text of words"), (None, "nameless text of words"), (4, None), (5, "")])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None", "None"]  # helpers add a null id of other words
    assert keep_one(nothing(spark)).count() == 0


def test_differencing():
    rng = random.Random(1)
    for shards in (2, 3, 16):
        sizes = [rng.randint(1, 1000) for _ in range(400)]
        at = difference(sizes, shards)
        sums = [sum(s for s, k in zip(sizes, at, strict=True) if k == j) for j in range(shards)]
        assert max(sums) - min(sums) <= 3
    assert difference([], 4) == [] and difference([5], 4) in ([0], [1], [2], [3])
    assert sorted(difference([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_shards(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = shard_documents(docs, shards=4).collect()
    key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(key(r.doc_id, r.text) for r in rows)
    slots, of_text = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert of_text.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2, 3}
    assert shard_documents(nothing(spark)).count() == 0


@pytest.mark.parametrize("items", [1 << 10, 1 << 14])
def test_shards_are_balanced(spark, items):
    """Groups of several sizes, one large by its bytes and one by its rows: no shard is off by more than a unit that is dealt."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 300)))) for i in range(3000)]
    rows += [(5000 + i, "the large text of a group " * 20) for i in range(40)] + [(6000 + i, "") for i in range(900)] + [(None, "x")] * 50
    got = shard_documents(documents(spark, rows, extra=False), shards=8, items=items).collect()
    assert len(got) == len(rows)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) <= sum(sums.values()) / items + 300  # a bundle, or a group that isn't large


def test_bundles():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 500, 5000)
    for bundles, chunk in ((16, 100), (64, 2048), (16, 10**6)):
        at = bundled(sizes, bundles, chunk)
        sums = np.bincount(at, sizes, bundles)
        assert len(at) == 5000 and sums.max() - sums.min() <= 500
    where, sums = combine(np.array([[9, 1], [5, 5], [8, 0]]))
    assert sorted(sums) == [14, 14] and len(bundled(sizes[:0], 4)) == 0 and {tuple(w) for w in where.tolist()} <= {(0, 1), (1, 0)}


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours(spark, block):
    rng = random.Random(8)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.0, 0.5]) for _ in range(6)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[1][1]), (202, None), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [float("nan")] * 6), (205, [float("inf")] * 6), (206, []), (207, [1.0]), (None, rows[2][1]), (208, [1e12] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    asked = df.where("vec_id % 10 = 0 OR vec_id = 207")
    got = top_k(df, asked, k=4, block=block, query_block=block)
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 10 == 0 or q == 207:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:4]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(df.where("false"), asked).count() == 0 and top_k(df, df.where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(0, [3e9, 3e9]), (1, [3e9, 3e9]), (2, [-3e9, -3e9]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        top_k(df, df.where("vec_id = 0"), k=2).collect()


def test_large_components_in_range(spark):
    """Products that a sum of doubles would round, and partial sums beyond 64 bits whose total fits."""
    rows = [(0, [2.0**31, 2.0**31, 1.0]), (1, [2.0**31, -(2.0**31), 7.0]), (2, [2.0**30, 3.0, 5.0]), (3, [2.0**30, 3.0, 4.0]), (4, [-(2.0**31), 2.0**31, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id = 0"), k=4, scale=1).orderBy("rank").collect()]
    dot = lambda v: sum(int(a) * int(b) for a, b in zip(rows[0][1], v))
    assert got == [(k, i, -s) for k, (s, i) in enumerate(sorted((-dot(v), i) for i, v in rows[1:]), 1)]
