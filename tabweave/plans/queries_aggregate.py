"""Queries for aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.scalars import dirty_cast
from tabweave.operators.aggregate import GRAINS, Aggregation, AggregationSpec, Order, aggregated, counters, must_decline
from tabweave.operators.filters import Filter, apply_filters, predicate, schema_of
from tabweave.plans.inputs import CELLS_SQL, cells, leading_sql

_N = leading_sql("cost")
_MEASURES = {
    "count_rows": (Aggregation("count", "*", "v"), "count(*)"),
    "count_values": (Aggregation("count", "vendor", "v"), "count(vendor)"),
    "count_distinct": (Aggregation("count", "vendor", "v", distinct=True), "count(DISTINCT coalesce(vendor, ''))"),
    "sum": (Aggregation("sum", "cost", "v"), f"coalesce(sum(coalesce({_N}, 0)), 0)"),
    "avg": (Aggregation("avg", "cost", "v"), f"sum(CASE WHEN cost <> '' THEN coalesce({_N}, 0) END) / nullif(count(nullif(cost, '')), 0)"),
    "min": (Aggregation("min", "cost", "v"), f"min({_N})"),
    "max": (Aggregation("max", "cost", "v"), f"max({_N})"),
}


def _grouped(a: Aggregation):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregated(cells(spark, sf_dir), AggregationSpec(["vendor", "region"], [a]))

    return run


def _total(a: Aggregation):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregated(cells(spark, sf_dir), AggregationSpec((), [a]))

    return run


ENTRIES = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggregationSpec(["shipped"], [Aggregation("count", "*", "n"), Aggregation("sum", "qty", "quantity"), Aggregation("sum", "price", "revenue")], {"shipped": "month"})
    return aggregated(apply_filters(cells(spark, sf_dir), [Filter("equals", "flag", ("R",))]), spec).withColumn("revenue", F.round("revenue", 2))


ENTRIES["flagship_monthly_revenue"] = (
    flagship,
    f"WITH {CELLS_SQL} SELECT date_trunc('month', shipped) AS shipped, count(*) AS n, sum(qty) AS quantity, round(sum(price), 2) AS revenue FROM c WHERE flag = 'R' GROUP BY 1",
)
for _name, (_a, _sql) in _MEASURES.items():
    ENTRIES[f"agg_{_name}"] = (_grouped(_a), f"WITH {CELLS_SQL} SELECT coalesce(vendor, 'Unknown') AS vendor, region, {_sql} AS v FROM c GROUP BY 1, 2")
    ENTRIES[f"total_{_name}"] = (_total(_a), f"WITH {CELLS_SQL} SELECT {_sql} AS v FROM c")
for _grain in GRAINS:
    for _col, _expr in (("shipped", "shipped"), ("placed", "try_strptime(placed, '%Y-%m-%d')")):

        def _trunc(spark: SparkSession, sf_dir: str, grain: str = _grain, col: str = _col) -> DataFrame:
            return aggregated(cells(spark, sf_dir), AggregationSpec([col], [Aggregation("count", "*", "n")], {col: grain}))

        ENTRIES[f"group_by_{_grain}_{_col}"] = (_trunc, f"WITH {CELLS_SQL} SELECT CAST(date_trunc('{_grain}', {_expr}) AS TIMESTAMP) AS {_col}, count(*) AS n FROM c GROUP BY 1")


def empty_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregated(cells(spark, sf_dir).where("qty < 0"), AggregationSpec((), [Aggregation("count", "*", "n"), Aggregation("sum", "cost", "s")]))


def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = AggregationSpec(["vendor", "region"], [Aggregation("sum", "cost", "total"), Aggregation("count", "*", "n")], order_by=[Order("total", True), Order("vendor"), Order("region")], limit=7)
    return aggregated(cells(spark, sf_dir), spec)


def blank_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregated(cells(spark, sf_dir), AggregationSpec(["vendor"], [Aggregation("count", "*", "n")], null_group=""))


_SPEC = AggregationSpec(["vendor"], [Aggregation("sum", "cost", "s"), Aggregation("min", "placed", "m"), Aggregation("count", "region", "d", distinct=True)])


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cells(spark, sf_dir)
    return counters(df, predicate(Filter("equals", "region", ("US",)), schema_of(df)), _SPEC)


def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("region").agg(F.count_if(dirty_cast(F.col("cost"))).alias("dirty"))


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and grains that aren't known, and sources that must decline."""
    df = cells(spark, sf_dir)

    def refused(spec: AggregationSpec) -> bool:
        try:
            aggregated(df, spec)
        except ValueError:
            return True
        return False

    rows = [(t, refused(AggregationSpec((), [Aggregation(t, "cost", "v")]))) for t in ("sum", "count", "median", "")]
    rows += [(g, refused(AggregationSpec(["placed"], [Aggregation("count", "*", "v")], {"placed": g}))) for g in ("month", "hour")]
    nulls = diagnostics(spark, sf_dir).first().null_group_rows
    rows += [(path, must_decline(path, n)) for path, n in (("a.csv", nulls), ("a.JSON", nulls), ("a.parquet", nulls), ("b.parquet", 0))]
    return spark.createDataFrame(rows, "what string, refused boolean")


ENTRIES |= {
    "refusals": (refusals, "SELECT * FROM (VALUES ('sum', FALSE), ('count', FALSE), ('median', TRUE), ('', TRUE), ('month', FALSE), ('hour', TRUE), ('a.csv', FALSE), ('a.JSON', TRUE), ('a.parquet', TRUE), ('b.parquet', FALSE)) t(what, refused)"),
    "total_of_nothing": (empty_total, "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s WHERE FALSE"),
    "groups_ordered_and_limited": (
        ordered_groups,
        f"WITH {CELLS_SQL} SELECT coalesce(vendor, 'Unknown') AS vendor, region, coalesce(sum(coalesce({_N}, 0)), 0) AS total, count(*) AS n FROM c GROUP BY 1, 2 ORDER BY total DESC NULLS LAST, vendor NULLS LAST, region NULLS LAST LIMIT 7",
    ),
    "group_null_as_blank": (blank_group, f"WITH {CELLS_SQL} SELECT coalesce(vendor, '') AS vendor, count(*) AS n FROM c GROUP BY 1"),
    "query_counters": (
        diagnostics,
        f"WITH {CELLS_SQL} SELECT (SELECT count(*) FROM c) AS source_rows, count(*) AS filtered_rows, greatest(count(*) FILTER (cost IS NULL OR cost = ''), count(*) FILTER (placed IS NULL OR placed = '')) AS null_measure_rows, count(*) FILTER (vendor IS NULL) AS null_group_rows FROM c WHERE region = 'US'",
    ),
    "dirty_cast_counter": (dirty_cells, f"WITH {CELLS_SQL} SELECT region, count(*) FILTER (({_N}) IS DISTINCT FROM TRY_CAST(CASE WHEN cost <> '0x10' THEN trim(cost) END AS DOUBLE) AND cost <> 'TRUE' OR cost = '0x10') AS dirty FROM c GROUP BY 1"),
}
