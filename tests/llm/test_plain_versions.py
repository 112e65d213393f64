"""Boosted trees, calibration and differencing against the same in plain Python."""

import heapq
import math
import random

import numpy as np
import pytest

from tabweave.llm.boosting import fit_isotonic, fit_trees
from tabweave.llm.sharding import shard_documents

from .helpers import documents


def plain_boosting(x, y, trees, depth, rate=0.15, bins=8, ridge=1.0, least=1.0):
    """Log odds of each row, by trying every cut of every feature on every node's rows."""
    n, width = len(x), len(x[0])
    share = (sum(y) + 0.5) / (n + 1)
    raw = [math.log(share / (1 - share))] * n
    cuts = []
    for j in range(width):
        column = sorted(r[j] for r in x)
        cuts.append(sorted({column[math.floor(q * (n - 1) / bins + 1e-9)] for q in range(1, bins)}))
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g, h = [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def grow(rows, level):
            if level < depth:
                best, split = 1e-6, None
                gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for j in range(width):
                    for c in cuts[j]:
                        left = [i for i in rows if x[i][j] <= c]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < least * 0.05 or ht - hl < least * 0.05:
                            continue
                        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                        if gain > best + 1e-9:
                            best, split = gain, (j, c)
                if split:
                    j, c = split
                    return grow([i for i in rows if x[i][j] <= c], level + 1) + grow([i for i in rows if x[i][j] > c], level + 1)
            return [(rows, rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge))]

        for rows, value in grow(list(range(n)), 0):
            for i in rows:
                raw[i] += value
    return raw


@pytest.mark.parametrize("seed", range(4))
def test_trees_are_those_of_plain_boosting(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(241, 3)).round(1 if seed % 2 else 6)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > -0.1) ^ (rng.random(241) < 0.1)).astype(float)
    got = fit_trees(x, y, trees=6, depth=2, bins=8).raw(x)
    assert got == pytest.approx(plain_boosting(x.tolist(), y.tolist(), 6, 2), abs=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_calibration_is_the_isotonic_regression(seed):
    rng = np.random.default_rng(seed)
    raw = rng.normal(size=120).round(seed % 3)
    y = (rng.random(120) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    points = sorted(set(raw.tolist()))
    mean = lambda a, b: y[(raw >= points[a]) & (raw <= points[b])].mean()
    want = [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    assert fit_isotonic(raw, y)(np.array(points)) == pytest.approx(want)


def plain_differencing(sizes, shards):
    """Sums of the shards, by heaps of tuples."""
    heap = [(-s, i, [s] + [0] * (shards - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, i, b = heapq.heappop(heap)
        both = sorted((p + q for p, q in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], len(sizes) + i, both))
    return sorted(heap[0][2])


@pytest.mark.parametrize("shards", [2, 3, 16])
def test_shards_are_those_of_plain_differencing(spark, shards):
    rng = random.Random(shards)
    texts = ["x" * n for n in rng.sample(range(1, 3000), 90)]
    rows = shard_documents(documents(spark, list(enumerate(texts)), extra=False), shards, items=1 << 22).collect()
    sums = [sum(r["size"] for r in rows if r.shard == k) for k in range(shards)]
    want = plain_differencing([len(t) + 1 for t in texts], shards)
    assert max(sums) - min(sums) <= max(1, 2 * (want[-1] - want[0])) and sum(sums) == sum(want)
    if shards == 2:
        assert sorted(sums) == want
