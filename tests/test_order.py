"""Pages against a plain stable sort, on seeded random rows."""

import random
from functools import cmp_to_key

from tabweave.operators.aggregate import Order
from tabweave.operators.order_page import sort_problem, top_page


def compare(a, b, order):
    for field, down in order:
        x, y = a[field], b[field]
        if x is None or y is None:
            if x is None and y is None:
                continue
            return 1 if x is None else -1
        if isinstance(x, str) and not x.lstrip("-").replace(".", "").isdigit():
            key = lambda v: (v.lower(), v.swapcase())
            x, y = key(x), key(y)
        else:
            x, y = float(x), float(y)
        if x != y:
            return (-1 if x < y else 1) * (-1 if down else 1)
    return a["__row_idx"] - b["__row_idx"]


def test_random_pages(spark):
    rng = random.Random(5)
    for _ in range(12):
        n = rng.randint(1, 40)
        rows = [{"a": rng.choice([None, *map(str, range(-3, 9)), "2.5"]), "b": rng.choice(["x", "y", "z", None, "Apple", "apple"]), "__row_idx": i} for i in range(n)]
        order = rng.choice([[("a", False)], [("a", True), ("b", False)], [("b", True), ("a", False)], [("b", False)]])
        offset, limit = rng.randint(0, 5), rng.randint(1, 12)
        df = spark.createDataFrame([(r["a"], r["b"], r["__row_idx"]) for r in rows], "a string, b string, __row_idx int")
        got = [r["__row_idx"] for r in top_page(df, [Order(f, d) for f, d in order], limit, offset).collect()]
        want = sorted(rows, key=cmp_to_key(lambda x, y: compare(x, y, order)))
        assert got == [r["__row_idx"] for r in want][offset : offset + limit], order


def test_deep_pages(spark):
    df = spark.range(30_000).selectExpr("id AS __row_idx", "CAST(pmod(hash(id), 997) AS STRING) AS v")
    rows = sorted(df.collect(), key=lambda r: (-int(r.v), r["__row_idx"]))
    for first, n in ((19_990, 30), (29_990, 30), (30_000, 5), (0, 25_000)):
        got = [r["__row_idx"] for r in top_page(df, [Order("v", True)], n, first).collect()]
        assert got == [r["__row_idx"] for r in rows[first : first + n]]


def test_dates_of_one_year_and_nulls_last(spark):
    df = spark.createDataFrame([("2024-03-01", 0), ("2024-01-15", 1), (None, 2), ("2024-02-01T10:00:00", 3)], "d string, __row_idx int")
    assert [r[0] for r in top_page(df, [Order("d")]).select("__row_idx").collect()] == [1, 3, 0, 2]
    assert [r[0] for r in top_page(df, [Order("d", True)]).select("__row_idx").collect()] == [0, 3, 1, 2]


def test_plan_keeps_the_first_rows_of_each_task(spark):
    df = spark.range(1000).selectExpr("id AS __row_idx", "id % 7 AS v")
    assert "TakeOrderedAndProject" in top_page(df, [Order("v")], 5, 2)._jdf.queryExecution().executedPlan().toString()


def test_safety(spark):
    df = spark.createDataFrame([("7",), ("1e3",), ("  42  ",), ("",), (None,)], "v string")
    assert tuple(sort_problem(df, [Order("v")]).first()) == (False, False)
    assert tuple(sort_problem(spark.createDataFrame([("apple",)], "v string"), [Order("v"), Order("w")]).first()) == (True, True)


def test_sought_pages(spark, monkeypatch):
    import random

    from tabweave.operators import order_page
    from tabweave.operators.order_page import page

    monkeypatch.setattr(order_page, "SEEK", (6, 3))
    rng = random.Random(4)
    places = sorted(rng.sample(range(1000), 300))
    shuffled = rng.sample(places, 300)
    df = spark.createDataFrame([(p, f"v{p}") for p in shuffled], "__row_idx long, v string")
    for first, n in ((0, 10), (5, 1), (290, 50), (299, 1), (300, 5), (120, 100), (63, 64)):
        got = page(df, n, first, top_rows=0)
        assert [r["__row_idx"] for r in got.collect()] == places[first : first + n]
    assert page(df.where("false"), 5, 1, top_rows=0).collect() == []
    plan = page(df, 5, 100, top_rows=0)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
