"""Fingerprints of rows, shapes of requests, and signatures of files of any size."""

from tabweave.operators.aggregate import Aggregation, AggregationSpec, Order
from tabweave.operators.filters import Filter
from tabweave.plans.lanes import Request, agree, shape_of
from tabweave.sources import files
from tabweave.sources.files import signature


def test_agreement_is_of_rows_in_any_order_with_repeats(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b double, c array<int>")
    rows = [("x", 1.0, [1]), ("x", 1.0, [1]), (None, float("nan"), None), ("", 0.0, [])]
    assert agree(spark, df(rows), df(rows[::-1])) and agree(spark, df(rows), df([*rows[:3], ("", -0.0, [])]))
    for other in ([*rows[:3]], [*rows, rows[0]], [*rows[:3], (None, 0.0, [])], [rows[0], rows[2], rows[2], rows[3]], [("1", 1.0, [1]), *rows[1:]]):
        assert not agree(spark, df(rows), df(other))
    assert not agree(spark, spark.sql("SELECT 1 AS a, NULL AS b"), spark.sql("SELECT NULL AS a, 1 AS b"))
    assert agree(spark, spark.sql("SELECT 1 AS a"), spark.sql("SELECT CAST(1 AS BIGINT) AS a")) and agree(spark, df([]), df([]))


def test_shapes_of_requests():
    spec = lambda *a, **k: Request(aggregation=AggregationSpec(["g", "h"], [Aggregation(*x) for x in a], **k))
    one = shape_of(spec(("sum", "x", "s"), ("count", "*", "n")))
    assert one == shape_of(spec(("count", "*", "n"), ("sum", "x", "s"))) == shape_of(Request(aggregation=AggregationSpec(["h", "g"], [Aggregation("sum", "x", "s"), Aggregation("count", "*", "n")])))
    others = [spec(("avg", "x", "s"), ("count", "*", "n")), spec(("sum", "y", "s"), ("count", "*", "n")), spec(("sum", "x", "s")), spec(("sum", "x", "s"), ("count", "*", "n"), limit=1), spec(("sum", "x", "s"), ("count", "*", "n"), date_truncs={"g": "day"}), spec(("sum", "x", "s"), ("count", "*", "n"), order_by=[Order("g")]), Request([Filter("equals", "g", ("a",))])]
    assert len({one, *map(shape_of, others)}) == 8
    assert shape_of(Request([Filter("equals", "g", ("a", "b"))])) == shape_of(Request([Filter("equals", "g", ("b", "a"))])) != shape_of(Request([Filter("gt", "g", ("b", "a"))]))


def test_signatures_of_files_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SIGNATURE_BLOCK", 16)
    monkeypatch.setattr(files, "SIGNATURE_FANOUT", 3)
    path = tmp_path / "a.bin"
    data = bytes(range(256)) * 3 + b"x"
    path.write_bytes(data)
    first = signature(spark, str(path))
    assert first == signature(spark, str(path), 1) == signature(spark, f"file://{path}", 1000)
    seen = {first}
    for at in (0, 15, 16, 400, len(data) - 1):
        path.write_bytes(data[:at] + b"?" + data[at + 1 :])
        seen.add(signature(spark, str(path), 2))
    path.write_bytes(data + b"x")
    assert len(seen | {signature(spark, str(path))}) == 7
    path.write_bytes(data)
    assert signature(spark, str(path)) == first
    folder = tmp_path / "f"
    folder.mkdir()
    for n in range(7):
        (folder / f"{n}.bin").write_bytes(data[: n * 40 + 1])
    whole = signature(spark, str(folder))
    assert whole == signature(spark, str(folder), 2)
    (folder / "6.bin").rename(folder / "7.bin")
    assert signature(spark, str(folder)) != whole
    path.write_bytes(b"")
    assert signature(spark, str(path)).startswith("sha:")
