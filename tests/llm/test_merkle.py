"""Merkle proofs against a tree built in plain Python, with trees of many rounds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tabweave.llm.merkle import leaf_of, prove


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """Levels from the leaves up to one node."""
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def beside(levels, i):
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        yield i % 16, run[: i % 16] + run[i % 16 + 1 :]
        i //= 16


def plain(rows):
    """rows of (doc_id, source, leaf, claim)."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for s in names}
    trees = {s: tree([r[2] for r in own[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (doc_id, _, leaf, claim) in enumerate(own[s]):
            path = [*beside(trees[s], i), *beside(top, j)]
            node = claim or leaf
            for at, others in path:
                node = h("".join([*others[:at], node, *others[at:]]))
            proof = h("".join(x for _, others in path for x in others))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, leaf string, claim string, chunk int, pos int, n_rows int, part int, at int, root string"


def made(counts):
    """Rows of sources with so many rows each; some ids are null, some rows repeat, every fifth is claimed otherwise."""
    rows = []
    for k, (name, n) in enumerate(counts.items()):
        for i in range(n):
            doc_id = None if i % 50 == 3 else 1000 * k + i // 2 * 2
            leaf = h(f"{name} {doc_id} {i % 3}")
            rows.append((doc_id, name, leaf, h(f"other {i}") if i % 5 == 0 else leaf if i % 7 == 0 else None))
    return rows


@pytest.mark.parametrize(("counts", "levels"), [({"one": 1}, 3), ({"a": 17}, 3), ({None: 700, "": 16, "b": 1, "é": 300, "z": 257}, 1), ({f"s{i}": 1 + i * i % 40 for i in range(35)} | {"big": 290, None: 5}, 1), ({f"t{i}": 1 + i % 3 for i in range(300)}, 1), ({"big": 5000, "c": 40}, 2)])
def test_equals_plain_tree(spark, counts, levels):
    rows = made(counts)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x") for r in rows], SCHEMA)
    assert sorted(map(str, (tuple(r) for r in prove(df, levels).collect()))) == sorted(map(str, plain(rows)))


def test_no_rows(spark):
    assert prove(spark.createDataFrame([], "doc_id long, source string, leaf string, claim string")).collect() == []


def test_leaf_of_odd_values(spark):
    df = spark.createDataFrame([(1, "é", None), (None, "", "x" * 300_000)], "a long, b string, c string")
    found = [r[0] for r in df.select(leaf_of(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert found == [h("1:12:é-"), h("-0:300000:" + "x" * 300_000)]
