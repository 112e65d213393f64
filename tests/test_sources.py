import pytest

from tabweave.operators.order_page import ROW
from tabweave.sources.files import collect_files, json_shape, read_any, read_delimited, read_json, signature, split_line, too_large, with_row_index
from tabweave.sources.xlsx import header_row, sheet_score, table, write_xlsx


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿id,Sample Name,sampleName,note\n1, "a, b" ,"say ""x""","two\nlines"\n\n2,é,,\n3,short\n', "utf-8")
    got = [tuple(r) for r in read_any(spark, str(path)).collect()]
    assert got == [("1", "a, b", 'say "x"', "two\nlines"), ("2", "é", "", ""), ("3", "short", "", "")]
    assert read_any(spark, str(path)).columns == ["id", "sample_name", "sample_name_1", "note"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_delimited(spark, str(path), strict=True).collect()


def test_row_index_over_splits_and_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i:05d}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = with_row_index(spark.read.text(str(tmp_path))).orderBy(ROW).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r[ROW] for r in got] == list(range(12000)) and [r["value"] for r in got] == sorted(r["value"] for r in got)


def test_json_shapes(spark, tmp_path):
    cases = {'[{"a": 1}, {"a": 2, "b": "x"}]': 2, '{"meta": {"data": [1]}, "items": [{"a": 1}]}': 1, '{"a": 1}': 1, "42": 0, '"x"': 0, '{"a": 1}\n{"a": 2}\n': 2, '{"value": [1, 2, 3]}': 3}
    for k, (text, n) in enumerate(cases.items()):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert read_json(spark, str(path)).count() == n, text
    (tmp_path / "cut.json").write_text('{"rows": {"data": []}, "x": "[", "records": [')
    assert json_shape(spark, str(tmp_path / "cut.json")) == "records"


def test_workbooks(spark, tmp_path):
    data = write_xlsx({"cover": [["x"], ["y"]], "data": [["banner"], ["A", "a", "", "Long Name", "D"], [1, "x", None, 2.5, True], [None], [2, "y & z", None, None, False]]})
    assert table(data) == (["a", "a_1", "column_3", "long_name", "d"], [["1", "x", None, "2.5", "true"], ["2", "y & z", None, None, "false"]])
    assert header_row([["a", "b", "c", "d"], [None]]) == -1 and sheet_score([["a"]]) == 0
    assert table(write_xlsx({"s": []})) == ([], [])
    path = tmp_path / "w.xlsx"
    path.write_bytes(data)
    assert read_any(spark, str(path)).count() == 2


def test_folders_and_limits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.csv", "y.csv", ".h.csv", "~z.csv", "t.doc"):
        (tmp_path / name).write_text("a\n1\n")
    assert sorted(r.path.rsplit("/", 1)[1] for r in collect_files(spark, str(tmp_path), ["csv", "tsv"]).collect()) == ["x.csv", "y.csv"]
    assert too_large(spark, str(tmp_path / "y.csv"), 3) and not too_large(spark, str(tmp_path / "y.csv"))
    one = signature(spark, str(tmp_path / "y.csv"))
    (tmp_path / "y.csv").write_text("a\n1\n2\n")
    assert one != signature(spark, str(tmp_path / "y.csv"))


def test_lines():
    assert split_line('a, "b, ""c""" ,,d') == ["a", 'b, "c"', "", "d"]


def test_best_sheet():
    from tabweave.sources.xlsx import best_sheet, fullest_sheet

    long, small = ("notes", [["a"]] * 50), ("table", [["name", "size", "kind", "place"], ["x", "1", "y", "z"], ["q", "2", "r", "s"]])
    assert best_sheet([long, small]) == small and fullest_sheet([long, small]) == long and best_sheet([long]) == long
