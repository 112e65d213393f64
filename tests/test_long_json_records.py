"""JSON of every shape in ranges of any size, and long first records."""

import json
import random

import pytest

from tabweave.sources.files import files_below, read_any, read_json
from tabweave.sources.json_splits import WRAPPERS, quotes_and_steps, read_arrays


def test_json_lines_after_a_long_first_record(spark, tmp_path):
    rows = [{"k": i, "items": [1], "text": ('a "{\\' * 9000) if not i else "b"} for i in range(5)]
    for name in ("a.json", "a.jsonl"):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)) + "\n")
        assert sorted(r.k for r in read_any(spark, str(tmp_path / name)).collect()) == list(range(5))


def value(rng, depth=0):
    k = rng.randrange(7 if depth < 3 else 5)
    if k < 5:
        return [rng.choice(['a"b\\', "x,]}[{:", "\n é", "data", "\\" * rng.randrange(6)]), 1.5, None, True, "z" * rng.randrange(100)][k]
    return [value(rng, depth + 1) for _ in range(rng.randrange(3))] if k == 5 else {rng.choice(["data", "a", "items"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
def test_elements_at_any_range_size(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for k in range(12 if size < 10 else 150):
        indent, mark = rng.choice([None, 1]), rng.choice(["", "﻿", " \n"])
        if k % 2:
            rows = [value(rng) for _ in range(rng.randrange(5))]
            text, want[f"{k:03d}.json"] = json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5), ("array", rows)
        else:
            made = {rng.choice(["data", "items", "rows", "meta", "x"]): value(rng) for _ in range(rng.randrange(5))}
            lines = rng.random() < 0.3
            key = None if lines else next((w for w in WRAPPERS if isinstance(made.get(w), list)), None)
            text = json.dumps(made, indent=indent) + ("\n\n{}" if lines else " \n")
            want[f"{k:03d}.json"] = ("lines" if lines else "object", made[key] if key else [])
        (tmp_path / f"{k:03d}.json").write_text(mark + text, "utf-8")
    for k, text in enumerate(("42", '"x]"', " ", "null", "﻿true")):
        (tmp_path / f"s{k}.json").write_text(text, "utf-8")
        want[f"s{k}.json"] = ("scalar", [])
    found, rows = read_arrays(spark, files_below(spark, str(tmp_path)), size)
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(f.path): f.shape for f in found} == {k: shape for k, (shape, _) in want.items()}
    got = {k: [] for k in want}
    for r in sorted(rows.collect(), key=lambda r: (r.path, r.at)):
        got[name(r.path)].append(json.loads(r.value))
    assert got == {k: rows for k, (_, rows) in want.items()}


def test_quotes_after_runs_of_backslashes():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(['"', "\\", "a", "{", "]"]) for _ in range(rng.randrange(1, 40))).encode()
        quotes, back = [], 0
        for c in text:
            quotes.append(c == 34 and back % 2 == 0)
            back = back + 1 if c == 92 else 0
        for at in range(len(text)):
            assert quotes_and_steps(text[at:], text[:at])[0].tolist() == quotes[at:]


def test_a_folder_of_several_shapes(spark, tmp_path):
    for name, text in {"a.json": '[{"k": 1}, {"k": 2}]', "b.json": '{"k": 3}\n{"k": 4}\n', "c.json": '{"items": [{"k": 5}]}', "d.json": '{"k": 6,\n "x": [1]}', "e.json": "7", "_SUCCESS": "x"}.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.k for r in read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6]
    assert read_json(spark, str(tmp_path / "e.json")).count() == 0 and read_json(spark, str(tmp_path / "*.none")).count() == 0


def test_many_small_ranges_are_dealt_out_evenly(spark, tmp_path):
    """Tasks follow from bytes and cores, not from the number of ranges, and no step reads all ranges in one task."""
    from tabweave.sources.json_splits import _ranges, _starts

    (tmp_path / "a.json").write_text(json.dumps([{"k": i, "note": 'a "]},\\ '} for i in range(5000)]))
    files = files_below(spark, str(tmp_path))
    count, cores = -(-files[0][1] // 200), spark.sparkContext.defaultParallelism
    ranges, starts = _ranges(spark, files, 200), _starts(spark, files, 200)
    assert ranges.count() == starts.count() == count > 500
    assert cores < starts.rdd.getNumPartitions() <= 4 * cores and ranges.rdd.getNumPartitions() <= 4 * cores
    assert sorted(r.k for r in read_json(spark, str(tmp_path), 200).collect()) == list(range(5000))
