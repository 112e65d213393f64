"""Exact search over components of any finite size, and bounds that hold for them."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm.va_topk import Queries, at_most, finite_vectors, products, scaled, top_k, whole_numbers


def floor_of(scale, x):
    with np.errstate(over="ignore"):
        return math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x)


def neighbours(rows, asked, k, scale=256):
    good = [(i, [floor_of(scale, x) for x in v]) for i, v in rows]
    out = []
    for q, v in good:
        if q in asked:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 4096])
def test_huge_components(spark, block):
    rng = random.Random(3)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1e20, 0.0]), (2, [0.5, -1.7e308, 0.0]), (3, [0.25, 1.7e308, 1e-300]), (4, [0.0, 0.0, 2.5]), (5, [-1e300, 0.0, 0.0]), (6, [-2.0**62, 3.0, 5.0]), (7, [2.0**30, 0.0, -1.0])]
    rows += [(10 + i, [rng.choice([rng.gauss(0, 1), 2.0 ** rng.randint(-1070, 10) * rng.choice([1, -1])]), rng.choice([0.0, 1e30, -1e200]), rng.gauss(0, 100)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id IN (0, 4)"), k=6, block=block, query_block=block)
    assert sorted(map(tuple, got.collect())) == neighbours(rows, {0, 4}, 6)


def test_too_small_scores_are_an_error_only_among_the_best(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1e300]), (2, [2.0]), (3, [-1e200])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in top_k(df, df.where("vec_id = 0"), k=1, block=1).collect()] == [2]
    with pytest.raises(Exception, match="64 bits"):
        top_k(df, df.where("vec_id = 0"), k=2, block=1).collect()


def test_parts_beyond_64_bits_that_cancel(spark):
    rows = [(0, [1e15, -1e15, 1.0])] + [(i, [1e15, 1e15 + i * 2.0, float(i)]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low = [(i, [x / 1e6 for x in v]) for i, v in rows]
    assert sorted(map(tuple, top_k(df, df.where("vec_id = 0"), k=5, scale=1).collect())) == neighbours(rows, {0}, 5, 1)
    small = spark.createDataFrame(low, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(small, small.where("vec_id = 0"), k=5).collect())) == neighbours(low, {0}, 5)


def test_bounds_hold_and_few_vectors_are_read(tmp_path):
    from tabweave.llm.token_files import _opened
    from tabweave.llm.va_topk import CELLS, VectorBlock, search_block

    rng = np.random.default_rng(5)
    for size in (1.0, 2.0**40, 2.0**70, 1e250, 1e305):
        x = rng.normal(size=(3000, 24)) * size
        x[::7] *= 2.0**-30
        q = rng.normal(size=(20, 24)) * rng.choice([1.0, size], (20, 1))
        y, power = scaled(x, 256)
        low, unit = y.min(0), (y.max(0) - y.min(0)) / CELLS
        path = f"file://{tmp_path}/{size}"
        for kind, data in ((".exact", x.astype("<f8").tobytes()), (".cells", np.array([power, *range(len(x))], "<i8").tobytes() + low.tobytes() + unit.tobytes() + np.minimum((y - low) / unit, CELLS).astype(np.uint8).tobytes())):
            with _opened(path + kind, "w") as f:
                f.write(data)
        block, asked = VectorBlock(path, len(x), 24), Queries(np.arange(-20, 0), q, 256)
        lower, upper = block.bounds(asked.scaled, block.cells)
        for i in (0, 7, 19):
            exact = products(whole_numbers(x[:200], 256).astype(object), asked.whole[i].astype(object))
            unit_of = 2 ** (block.power + asked.power)
            from fractions import Fraction

            assert all(Fraction(float(lower[i, j])) <= Fraction(int(s), unit_of) <= Fraction(float(upper[i, j])) for j, s in enumerate(exact))
        best = [[] for _ in range(20)]
        read = search_block(block, asked, best, 5)
        assert read < 0.6 * len(x)  # bounds tell vectors apart at every size
        whole = whole_numbers(x, 256).astype(object)
        for i in (3, 11):
            assert best[i] == sorted(zip((whole @ asked.whole[i].astype(object)).tolist(), range(len(x))), key=lambda p: (-p[0], p[1]))[:5]


def test_whole_numbers_and_thresholds():
    for x in (0.1, -0.1, 2.0**53 + 2, -(2.0**62), 1e19, 1.7e308, -1.7e308, 5e-324):
        assert int(whole_numbers(np.array([[x]]), 256)[0, 0]) == floor_of(256, x)
    for score in (0, 5, -5, 2**70 + 1, -(2**70) - 1, 2**2000, -(2**2000)):
        for power in (0, 3, 500):
            found = at_most(score, power)
            assert found == -math.inf or int(found) * 2**power <= score or found <= score / 2**power
    got = finite_vectors(pa.array([[1.0, 2.0], None, [], [float("nan"), 1.0], [1e308, -1.0], [None, 1.0], [3.0]]))
    assert {w: r.tolist() for w, (r, _) in got.items()} == {2: [0, 4], 1: [6]}
