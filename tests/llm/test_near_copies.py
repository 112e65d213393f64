"""The pipeline's near copies against brute force over five-word shingles."""

import random

import pytest

from tabweave.llm.near_copies import LEAST, keep_one_copy, near_copies, shingles, sketch

from .helpers import documents, nothing
from .test_groups import joined


def planted():
    rng, out = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for size in (30, 60, 120, 300):
        for family in range(6):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for copy in range(9 if family else 40):
                made = list(base)
                for _ in range(rng.randint(0, 1 + size // 40)):
                    made[rng.randrange(size)] = word()
                out.append(" ".join(made[rng.randint(0, 2) :]).upper() if copy % 3 else " ".join(made))
    return [*out, None, "", " \n", "one two", "ONE two", "one two three four five"]


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_of(texts):
    sets = [shingled(t) for t in texts]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 9 * len(a & b) >= 4 * (len(a) + len(b))]
    return joined(list(range(len(texts))), pairs), sum(sets[i] != sets[j] for i, j in pairs)


@pytest.mark.parametrize("light", [3, 16])
def test_components_are_those_of_brute_force(spark, light):
    texts = planted()
    want, near = components_of(texts)
    assert near > 500
    got = {r.doc_id: r.component_id for r in near_copies(documents(spark, list(enumerate(texts)), extra=False), light).collect()}
    assert got == want


def test_the_stage_keeps_one_of_each(spark):
    import corpus_pipeline

    texts = planted()
    docs = documents(spark, list(enumerate(texts)), extra=False)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components_of(texts)[0].values()))
    assert kept.columns == docs.columns and keep_one_copy(nothing(spark)).count() == 0


def test_sketches_never_rule_out_a_pair_in_reach():
    rng = random.Random(9)
    for size in (1, 5, 40, 150, 900, 6000):
        for _ in range(30):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
            made = list(base)
            for _ in range(rng.randint(0, max(1, size // 20))):
                made[rng.randrange(len(made))] = "other"
            x, y = (shingles(" ".join(t).encode()) for t in (base, made))
            differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(sketch(x), sketch(y), strict=True))
            apart = len(set(x.tolist()) ^ set(y.tolist()))
            assert differ <= apart and (apart - differ) % 2 == 0
            if LEAST[1] * len(set(x.tolist()) & set(y.tolist())) >= LEAST[0] * len(set(x.tolist()) | set(y.tolist())):
                assert sum(LEAST) * differ <= (LEAST[1] - LEAST[0]) * (len(x) + len(y))


def pages(n, shared=300, own=120, copies=0, seed=3):
    """Pages of one template, which are no near copies, and near copies of some of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    frame = [word() for _ in range(shared)]
    made = [[word() for _ in range(own)] for _ in range(n)]
    for k in range(copies):
        body = list(made[k * 7 % n])
        body[rng.randrange(own)] = word()
        made.append(body)
    return [" ".join(frame[:100] + body + frame[100:]) for body in made]


def test_pages_of_a_template(spark):
    texts = pages(150, copies=40) + pages(30, 300, 20, 10, seed=4) + planted()[:120]
    want, near = components_of(texts)
    assert near > 30
    got = {r.doc_id: r.component_id for r in near_copies(documents(spark, list(enumerate(texts)), extra=False), 4).collect()}
    assert got == want


def test_pairs_of_pages_grow_no_faster_than_pages(spark, monkeypatch):
    from tabweave.llm import near_copies as module

    met, search = [], module.near_by_rare_shingles

    def counted(classes, texts):
        out = search(classes, texts).persist()
        met.append((classes.count(), out.count()))
        return out

    monkeypatch.setattr(module, "near_by_rare_shingles", counted)
    for n in (400, 1600):
        docs = documents(spark, list(enumerate(pages(n, copies=n // 20))), extra=False)
        assert near_copies(docs).select("component_id").distinct().count() == n
    assert met[0][0] > 300 and met[1][0] > 1200  # they stand in crowded buckets
    assert all(pairs <= classes // 5 for classes, pairs in met)


def test_names_of_other_columns(spark):
    names = ["kept_id", "fp", "root", "row", "row_id", "row_text", "row_fp", "component_id", "own_fp", "a.b"]
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base), (2, base), (2, "something else that is long enough to stand alone"), (None, "no id here but some words"), (None, None), (5, base + " thirteen")]
    docs = spark.createDataFrame([(i, t, *[i] * len(names)) for i, t in rows], "doc_id long, text string" + "".join(f", `{c}` long" for c in names))
    kept = keep_one_copy(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text, r.kept_id) for r in kept.collect()))) == sorted(map(str, ((i, t, i) for i, t in [rows[0], *rows[2:5]])))


def test_files_between_steps_follow_from_the_rows(spark, monkeypatch):
    from tabweave.llm import components, near_copies, simhash

    files, keys = {}, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for module in (components, near_copies, simhash):

        def counted(df, name, *more, write=module.written):
            out = write(df, name, *more)
            files[name] = max(files.get(name, 0), len(out.inputFiles()))
            return out

        monkeypatch.setattr(module, "written", counted)
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        made = pages(120, copies=6) + planted()[:60]
        kept = keep_one_copy(documents(spark, list(enumerate(made)), extra=False))
        assert {r.doc_id for r in kept.collect()} == set(components_of(made)[0].values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 15
    assert max(files.values()) <= 4, files
