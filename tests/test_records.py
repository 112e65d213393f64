"""Delimited files in splits of any size against a reader of whole files."""

import csv
import io
import random

import pytest

from tabweave.functions.normalize import distinct_names
from tabweave.sources.files import read_any, read_delimited, sniff_delimiter
from tabweave.sources.records import ends_open, records


@pytest.fixture
def splits(spark):
    """Sets the size of splits, and puts back what was there."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(keys, (str(size), "1"), strict=True)]
    for k, v in before.items():
        spark.conf.set(k, v)


def made(seed, n, feed="\n"):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["a", "", "b c", 'say "x"', 'q, "y"', f"two{feed}lines", f"{feed}", '"', "é", f'",{feed}"', 'half " one', "x" * rng.randint(0, 60) + f"{feed}" * rng.randint(0, 3)])
    return [[str(i), *(cell() for _ in range(3))] for i in range(n)]


def text_of(rows, feed="\n", delimiter=","):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator=feed).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [37, 300, 5000])
def test_rows_are_the_same_at_any_split_size(spark, tmp_path, splits, seed, size):
    rng, feed = random.Random(seed), "\r\n" if seed % 2 else "\n"
    files = {f"{k}.csv": made(seed * 10 + k, rng.randint(1, 60), "\n") for k in range(3)}
    for name, rows in files.items():
        (tmp_path / name).write_bytes((("﻿" if name == "1.csv" else "") + text_of([["id", "x", "y", "z"], *rows], feed) + rng.choice(["", "\n", "  \n\n"])).encode())
    splits(size)
    df = read_delimited(spark, str(tmp_path), multi_line=True)
    assert size > 1000 or records(spark, str(tmp_path)).rdd.getNumPartitions() >= 1
    got = sorted(tuple(c.replace("\r\n", "\n").strip() for c in r) for r in df.collect())
    assert got == sorted(tuple(c.strip() for c in r) for rows in files.values() for r in rows)
    places = {}
    for r in records(spark, str(tmp_path)).collect():
        places.setdefault(r.path, []).append(r.place)
    assert sorted(map(len, places.values())) == sorted(len(rows) + 1 for rows in files.values()) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_record_over_many_splits_and_one_that_never_closes(spark, tmp_path, splits):
    rows = [["id", "t"], ["1", "line\n" * 200 + "end"], ["2", "b"], ["3", "c\n\n" * 50]]
    (tmp_path / "a.csv").write_text(text_of(rows) + '4,"open\nto the end')
    splits(64)
    got = {r.id: r.t for r in read_any(spark, str(tmp_path / "a.csv")).collect()}
    assert got["1"] == rows[1][1] and got["2"] == "b" and got["3"].strip() == rows[3][1].strip() and got["4"].strip('"') == "open\nto the end"
    with pytest.raises(Exception, match="a record of over 300 characters"):
        records(spark, str(tmp_path / "a.csv"), most=300).collect()


def test_ends_open():
    cases = {'a,"b': True, 'a,"b"': False, 'a,"b""': True, 'a,5" disk': False, '"a"x"b,"c': True, ' "a': True, '"a""b""': True, "": False, '"': True, '""': False, '"""': True, 'a" ,"b"c"d': False}
    assert {k: ends_open(k, False, ",") for k in cases} == cases
    assert ends_open('x""y', True, ",") and not ends_open('x",y', True, ",") and ends_open('x", "y', True, ",") and ends_open("x", True, ",")


def test_stray_quotes_do_not_join_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text('size,name\n5" disk,a\n3" disk,b\n7" x,"c, d"\n"e\nf",g\n')
    assert sorted(map(tuple, read_any(spark, str(tmp_path / "s.csv")).collect())) == sorted([('5" disk', "a"), ('3" disk', "b"), ('7" x', "c, d"), ("e\nf", "g")])


def test_headers_and_delimiters(spark, tmp_path):
    assert distinct_names(["x", "x", "x_1", "X", "", "column_5", None]) == ["x", "x_1", "x_1_1", "x_2", "column_5", "column_5_1", "column_7"]
    for k, (d, body) in enumerate({";": "x;x;x_1\n1;2,5;3\n4;5;6\n", "|": 'x|x|x_1\n1|"2;5"|3\n4|5|6\n', ",": "\n\nx,x,x_1\n1,2;5,3\n4,5,6\n", "\t": "x\tx\tx_1\n1\t2,5\t3\n4\t5\t6\n"}.items()):
        (tmp_path / f"{k}.csv").write_text(body)
        df = read_any(spark, str(tmp_path / f"{k}.csv"))
        assert df.columns == ["x", "x_1", "x_1_1"] and sniff_delimiter(body) == d
        assert sorted(r.x_1 for r in df.collect()) == sorted(["2;5" if d in "|," else "2,5", "5"])
    (tmp_path / "q.csv").write_text('"a\nb",c,"c"\n1,2,3\n')
    assert read_any(spark, str(tmp_path / "q.csv")).columns == ["a_b", "c", "c_1"]
    (tmp_path / "none.csv").write_text("")
    assert read_any(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_any(spark, str(tmp_path / "head.csv")).collect() == []
