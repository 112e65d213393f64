"""Filters against a plain evaluation of every operator on every kind of cell."""

import itertools

from tabweave.operators.filters import Filter, ValueMap, apply_filters

CELLS = ["Sigma", "  SIGMA ", "sigma-aldrich [usa]", "other", "", None]
VALUES = [(), ("Sigma-Aldrich",), ("sigma",), ("",), ("Sigma-Aldrich", "other"), ("null",)]
OPERATORS = ["set", "notSet", "equals", "notEquals", "contains", "notContains", "startsWith", "notStartsWith", "endsWith", "notEndsWith"]
PAIRS = (("sigma-aldrich [usa]", "Sigma-Aldrich"), ("sigma", "Sigma-Aldrich"), ("neb", "New England Biolabs"))


def mapped(raw, others):
    if not raw:
        return None
    return dict(PAIRS).get(raw.strip().lower(), raw if others else None)


def holds(op, v, values):
    if op in ("set", "notSet"):
        return bool(v) == (op == "set")
    name = op.removeprefix("not")
    name = name[0].lower() + name[1:]
    tests = {
        "equals": lambda x: v == x,
        "contains": lambda x: x.lower() in v.lower(),
        "startsWith": lambda x: v.lower().startswith(x.lower()),
        "endsWith": lambda x: v.lower().endswith(x.lower()),
    }
    hit = v is not None and any(tests[name](x) for x in values)
    return hit != op.startswith("not")


def test_value_map_matrix(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, vendor string")
    plans, expected = [], []
    for k, (op, values, others) in enumerate(itertools.product(OPERATORS, VALUES, (False, True))):
        out = apply_filters(df, [Filter(op, values=values, value_map=ValueMap("vendor", PAIRS, others))])
        plans.append(out.selectExpr(f"{k} AS k", "i"))
        expected += [(k, i) for i, c in enumerate(CELLS) if holds(op, mapped(c, others), values)]
    whole = plans[0]
    for p in plans[1:]:
        whole = whole.union(p)
    assert sorted((r.k, r.i) for r in whole.collect()) == sorted(expected)


def test_plain_cells_read_null_as_text(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, vendor string")
    ids = lambda *f: [r.i for r in apply_filters(df, f).orderBy("i").collect()]
    assert ids(Filter("contains", "vendor", ("ul",))) == [5]
    assert ids(Filter("notContains", "vendor", ("ul",))) == [0, 1, 2, 3, 4, 5]
    assert ids(Filter("equals", "vendor", (None,))) == [5]
    assert ids(Filter("equals", "gone", ("undefined",))) == [0, 1, 2, 3, 4, 5]
    assert ids(Filter("gt", "gone", (1,))) == []
    assert ids(Filter("lt", "vendor", (5,))) == [4, 5]  # blank and null are zero
    assert ids(Filter("gt", "vendor", ("x",))) == []
    assert ids() == [0, 1, 2, 3, 4, 5]


def test_large_maps_are_joined(spark):
    rows = [(i, f" K{i} ", i) for i in range(600)] + [(600, None, 0), (601, "", 0), (602, "other", 0)]
    df = spark.createDataFrame(rows, "i int, vendor string, __map0_hit int")
    pairs = [(f"k{i}", "wrong") for i in range(500)] + [(f"k{i}", f"v{i % 3}") for i in range(500)]
    out = apply_filters(df, [Filter("equals", value_map=ValueMap("vendor", pairs), values=("v1",)), Filter("lt", "i", (300,)), Filter("set", value_map=ValueMap("vendor", pairs))])
    assert out.columns == df.columns and sorted(r.i for r in out.collect()) == [i for i in range(300) if i % 3 == 1]
    kept = apply_filters(df, [Filter("notEquals", value_map=ValueMap("vendor", pairs, True), values=("v0", "v1", "v2"))])
    assert sorted(r.i for r in kept.collect()) == list(range(500, 603))
    assert apply_filters(df.where("false"), [Filter("set", value_map=ValueMap("vendor", pairs))]).count() == 0


def test_empty_map_and_tables(spark):
    df = spark.createDataFrame([], "i int, vendor string")
    assert apply_filters(df, [Filter("set", value_map=ValueMap("vendor", ()))]).count() == 0
    one = spark.createDataFrame([(1, "a")], "i int, vendor string")
    assert apply_filters(one, [Filter("equals", value_map=ValueMap("vendor", (), True), values=("a",))]).count() == 1
    assert apply_filters(one, [Filter("notSet", value_map=ValueMap("gone", PAIRS))]).count() == 1
