import pytest

from tabweave.operators.aggregate import Aggregation, AggregationSpec, aggregated, must_decline
from tabweave.plans.lanes import Request, answer

SALES = [("Acme", "EU", "10", "1"), ("Acme", "EU", "", "2"), ("Acme", "US", "5.5", "3"), ("Bolt", "EU", "-3", "4"), ("Bolt", "US", "7", "5"), ("", "US", "1", "6"), (None, "EU", "2 kg", "7")]


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(SALES, "vendor string, region string, cost string, qty string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups(sales):
    spec = AggregationSpec(["vendor"], [Aggregation("sum", "cost", "s"), Aggregation("avg", "cost", "a"), Aggregation("count", "cost", "c"), Aggregation("count", "cost", "d", True)])
    assert rows(aggregated(sales, spec)) == rows_of([("Acme", 15.5, 7.75, 3, 3), ("Bolt", 4.0, 2.0, 2, 2), ("", 1.0, 1.0, 1, 1), ("Unknown", 2.0, 2.0, 1, 1)])


def rows_of(x):
    return sorted(x, key=str)


def test_totals_and_nothing(sales, spark):
    spec = AggregationSpec((), [Aggregation("sum", "cost", "s"), Aggregation("min", "cost", "lo"), Aggregation("max", "vendor", "none"), Aggregation("count", "*", "n")])
    assert rows(aggregated(sales, spec)) == [(22.5, -3.0, None, 7)]
    assert rows(aggregated(sales.where("false"), spec)) == []
    assert rows(aggregated(sales, AggregationSpec(["gone"], [Aggregation("count", "gone", "n")]))) == [("Unknown", 0)]


def test_refusals(sales):
    with pytest.raises(ValueError):
        aggregated(sales, AggregationSpec((), [Aggregation("median", "cost", "m")]))
    with pytest.raises(ValueError):
        aggregated(sales, AggregationSpec(["vendor"], (), {"vendor": "decade"}))
    assert must_decline("x.JSON", 1) and not must_decline("x.csv", 1) and not must_decline("x.parquet", 0)


def test_answers(sales):
    out = answer(sales, Request(aggregation=AggregationSpec(["region"], [Aggregation("count", "*", "n")])))
    assert out.aggregation_applied and out.total_rows == 2 and out.diagnostics["source_rows"] == 7
    assert answer(sales, Request(expected_signature="a"), "b").signature_mismatch
    assert answer(sales, Request(columns=["qty", "gone"], ties=("qty",), limit=2)).data.collect() == [("1",), ("2",)]
