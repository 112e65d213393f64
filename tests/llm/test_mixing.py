"""The mix of sources against targets by repeated sharing and edges by sorting, in plain Python."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from tabweave.llm.mixing import drawn_texts, mix_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share, most):
    """Each source's target: what is above its most is shared by the others, again and again."""
    out = {s: Fraction(0) for s in sizes}
    left, open_ = Fraction(share) * sum(sizes.values()), set(sizes)
    while left and open_:
        all_weights = sum(Fraction(weights[s]) for s in open_)
        for s in open_:
            out[s] += left * Fraction(weights[s]) / all_weights
        left = Fraction(0)
        for s in [s for s in open_ if out[s] >= most * sizes[s]]:
            left += out[s] - most * sizes[s]
            out[s] = Fraction(most * sizes[s])
            open_.discard(s)
    return out


def plain(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, size, source_size, taken) and each source's target."""
    sized = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = plain_targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(names)}, share, most)
    out = []
    for s in names:
        words, before = int(target[s] + Fraction(1, 2)), 0
        copies, rest = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        for i, _, n, _ in sorted((r for r in sized if r[1] == s), key=lambda r: r[3]):
            out.append((i, n, sizes[s], copies * n + max(0, min(n, rest - before))))
            before += n
    return out, target


def rows_of(seed, sources, n=200):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), rng.choice([None, "", " \n", "w\x1fx é y z", *["a b " * rng.randint(1, 30)] * 6])) for k in range(n)]


CASES = {
    "few": rows_of(1, ["a", "b", "c"]),
    "many": rows_of(2, [None, "", *(f"s{i}" for i in range(25))]),
    "one large, one long text": [*rows_of(3, ["x", "y"], 40), *((1000 + i, "big", "q " * 20) for i in range(400)), (9, "long", "w " * 50_000), (None, "long", "n n n")],
    "a third are the same row": [*rows_of(4, ["a", "b"], 100), *[(7, "b", "all the same words")] * 150],
    "no words": [(1, "a", ""), (2, None, None)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_plain(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, 1, 2, 3, "h", 5.0) for r in rows], "doc_id long, source string, text string, size int, row int, taken int, hash string, weight double")
    mixed = mix_documents(df, keep=("doc_id", "size", "taken"))
    found, (want, target) = mixed.collect(), plain(rows)
    assert sorted((str(r.doc.doc_id), r["size"], r.source_size, r.taken) for r in found) == sorted((str(i), *rest) for i, *rest in want)
    assert all(r.doc["size"] == 1 and r.doc.taken == 3 and r.taken <= 2 * r["size"] for r in found)
    assert sorted({round(r.target, 6) for r in found}) == pytest.approx(sorted({round(float(t), 6) for t in target.values()}))
    assert sorted(map(str, mix_documents(df, keep=("doc_id",)).select("doc.doc_id", "taken").collect())) == sorted(f"Row(doc_id={r.doc.doc_id}, taken={r.taken})" for r in found)


def test_share_above_most_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string")
    assert sorted((r.doc.doc_id, r.taken) for r in mix_documents(df, share=5).collect()) == [(1, 4), (2, 2)]
    assert mix_documents(df.limit(0)).collect() == []


def test_texts_are_drawn_as_often_as_taken(spark):
    df = spark.createDataFrame(CASES["few"], "doc_id long, source string, text string")
    mixed = mix_documents(df, keep=("doc_id", "text")).persist()
    taken = {r.doc.doc_id: r.taken for r in mixed.collect() if r.taken}
    drawn = defaultdict(list)
    for r in drawn_texts(mixed).collect():
        drawn[r.doc.doc_id].append((r["copy"], r["words"]))
    assert {i: sum(len(w) for _, w in x) for i, x in drawn.items()} == taken
    texts = {r[0]: r[2] for r in CASES["few"]}
    assert all(w == WORD.findall(texts[i])[: len(w)] and sorted(c for c, _ in x) == list(range(len(x))) for i, x in drawn.items() for _, w in x)
