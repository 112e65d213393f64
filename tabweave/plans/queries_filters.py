"""Queries for filters: each returns the keys of the rows that a filter keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.scalars import text_of
from tabweave.operators.aggregate import Aggregation, AggregationSpec, aggregated
from tabweave.operators.filters import Filter, ValueMap, apply_filters
from tabweave.plans.inputs import CELLS_SQL, cells, number_sql, table, text_sql

PAIRS = (("sigma-aldrich [usa]", "Sigma-Aldrich"), ("sigma", "wrong"), ("neb", "New England Biolabs"), ("sigma", "Sigma-Aldrich"), ("vendor 3", ""))
ONE, OTHERS = ValueMap("vendor", PAIRS), ValueMap("vendor", PAIRS, keep_others=True)


def _mapped(others: bool) -> str:
    rest = "vendor" if others else "NULL"
    hit = "CASE lower(trim(vendor)) WHEN 'sigma-aldrich [usa]' THEN 'Sigma-Aldrich' WHEN 'sigma' THEN 'Sigma-Aldrich' WHEN 'neb' THEN 'New England Biolabs' WHEN 'vendor 3' THEN ''"
    return f"CASE WHEN vendor IS NULL OR vendor = '' THEN NULL ELSE {hit} ELSE {rest} END END"


_V, _Q, _C = "coalesce(vendor, 'null')", text_sql("qty"), number_sql("cost")
_DATED = "try_strptime(placed, '%Y-%m-%d')"
PLAIN: dict[str, tuple[list[Filter], str]] = {
    "filter_equals": ([Filter("equals", "vendor", ("NEB", "Vendor 3", "null"))], f"{_V} IN ('NEB', 'Vendor 3', 'null')"),
    "filter_equals_number": ([Filter("equals", "qty", (17, 23.0, "31"))], f"{_Q} IN ('17', '23', '31')"),
    "filter_not_equals": ([Filter("notEquals", "vendor", ("NEB", ""))], f"{_V} NOT IN ('NEB', '')"),
    "filter_contains": ([Filter("contains", "vendor", ("SIGMA", "dor 1"))], f"contains(lower({_V}), 'sigma') OR contains(lower({_V}), 'dor 1')"),
    "filter_contains_null_text": ([Filter("contains", "vendor", ("ul",))], f"contains({_V}, 'ul')"),
    "filter_not_contains": ([Filter("notContains", "vendor", ("ul", "sigma"))], "vendor IS NULL OR NOT (contains(lower(vendor), 'ul') OR contains(lower(vendor), 'sigma'))"),
    "filter_starts_with": ([Filter("startsWith", "vendor", ("ven", "n"))], f"starts_with(lower({_V}), 'ven') OR starts_with(lower({_V}), 'n')"),
    "filter_ends_with": ([Filter("endsWith", "vendor", ("]", " 2"))], f"ends_with({_V}, ']') OR ends_with({_V}, ' 2')"),
    "filter_not_starts_with": ([Filter("notStartsWith", "vendor", ("ven",))], "vendor IS NULL OR NOT starts_with(lower(vendor), 'ven')"),
    "filter_not_ends_with": ([Filter("notEndsWith", "vendor", ("b",))], "vendor IS NULL OR NOT ends_with(lower(vendor), 'b')"),
    "filter_gt": ([Filter("gt", "cost", ("100",))], f"({_C}) > 100"),
    "filter_lt": ([Filter("lt", "cost", (5,))], f"({_C}) < 5"),
    "filter_gte": ([Filter("gte", "qty", (25,))], "qty >= 25"),
    "filter_lte": ([Filter("lte", "cost", (42,))], f"({_C}) <= 42"),
    "filter_gt_date": ([Filter("gt", "placed", ("1995-06-17",))], f"{_DATED} > TIMESTAMP '1995-06-17'"),
    "filter_lte_date": ([Filter("lte", "placed", ("1996-01-01T00:00:00",))], f"{_DATED} <= TIMESTAMP '1996-01-01'"),
    "filter_gte_timestamp": ([Filter("gte", "shipped", ("1996-03-05",))], "shipped >= TIMESTAMP '1996-03-05'"),
    "filter_set": ([Filter("set", "vendor")], "vendor IS NOT NULL AND vendor <> ''"),
    "filter_not_set": ([Filter("notSet", "vendor")], "vendor IS NULL OR vendor = ''"),
    "filter_unknown_operator": ([Filter("resembles", "vendor", ("x",))], "TRUE"),
    "filter_missing_column": ([Filter("equals", "nowhere", ("undefined",)), Filter("contains", "vendor", ("neb",))], "vendor = 'NEB'"),
    "filter_conjunction": ([Filter("equals", "region", ("EU", "US")), Filter("equals", value_map=ONE, values=("Sigma-Aldrich",)), Filter("gt", "qty", (10,))], f"region IN ('EU', 'US') AND ({_mapped(False)}) = 'Sigma-Aldrich' AND qty > 10"),
}
_TESTS = {
    "set": ((), "coalesce({m} <> '', FALSE)"),
    "notSet": ((), "NOT coalesce({m} <> '', FALSE)"),
    "equals": (("Sigma-Aldrich", "Vendor 1"), "coalesce({m} IN ('Sigma-Aldrich', 'Vendor 1'), FALSE)"),
    "notEquals": (("Sigma-Aldrich",), "NOT coalesce({m} = 'Sigma-Aldrich', FALSE)"),
    "contains": (("ENGLAND", "dor 2"), "coalesce(contains(lower({m}), 'england') OR contains(lower({m}), 'dor 2'), FALSE)"),
    "notContains": (("sigma",), "NOT coalesce(contains(lower({m}), 'sigma'), FALSE)"),
    "startsWith": (("new", "ven"), "coalesce(starts_with(lower({m}), 'new') OR starts_with(lower({m}), 'ven'), FALSE)"),
    "notStartsWith": (("SIG",), "NOT coalesce(starts_with(lower({m}), 'sig'), FALSE)"),
    "endsWith": (("labs", "1"), "coalesce(ends_with(lower({m}), 'labs') OR ends_with(lower({m}), '1'), FALSE)"),
    "notEndsWith": (("rich",), "NOT coalesce(ends_with(lower({m}), 'rich'), FALSE)"),
    "gt": ((1,), "TRUE"),
}


def _query(filters: list[Filter]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_filters(cells(spark, sf_dir), filters).select("k")

    return run


def _sql(where: str) -> str:
    return f"WITH {CELLS_SQL} SELECT k FROM c WHERE {where}"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


#: A map far too large for a plan: every second vendor's number by its text, and texts that no cell has.
LARGE = ValueMap("part", tuple((f"part {i}", f"Part of {i % 10}") for i in range(0, 100_000, 2)))
_DOUBLES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 30 AS x FROM lineitem"


def large_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value map of 50,000 entries."""
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "' PART ' || CAST(l_partkey AS STRING) AS part")
    return apply_filters(df, [Filter("equals", value_map=LARGE, values=("Part of 2", "Part of 4"))]).select("l_orderkey", "l_partkey")


def large_map_keeping_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "'part ' || CAST(l_partkey AS STRING) AS part")
    spec = ValueMap("part", LARGE.pairs, keep_others=True)
    return apply_filters(df, [Filter("notContains", value_map=spec, values=("OF",)), Filter("endsWith", value_map=spec, values=("1", "3"))]).select("l_orderkey", "l_partkey")


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice / 30 AS x")


def double_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of doubles with as many digits as they need."""
    df = _doubles(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text_of(F.col("x"), df.schema["x"].dataType).alias("t"))


def awkward_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [1 / 30, 0.1 + 0.2, 0.3, 1e-7, 1.5e-6, 1e21, 1.25e20, -123456789012.125, -0.0, 2e-308, 1.7976931348623157e308]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x double")
    kept = [apply_filters(df, [Filter("equals", "x", (x,))]).select("i", text_of(F.col("x"), df.schema["x"].dataType).alias("t")) for x in rows]
    return reduce(DataFrame.union, kept)


def double_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct doubles stay distinct when counted, and as keys of groups."""
    df = _doubles(spark, sf_dir)
    counted = aggregated(df, AggregationSpec((), [Aggregation("count", "x", "distinct_x", True)]))
    groups = aggregated(apply_filters(df, [Filter("notEquals", "x", (0.1,))]), AggregationSpec(("x",), [Aggregation("count", "*", "n")]))
    return counted.crossJoin(groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")))  # of a single row each


ENTRIES = {name: (_query(f), _sql(w)) for name, (f, w) in PLAIN.items()}
ENTRIES |= {
    "value_map_large": (large_map, "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey < 100000 AND l_partkey % 10 IN (2, 4)"),
    "value_map_large_keeping_others": (large_map_keeping_others, "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_partkey % 2 = 1 OR l_partkey >= 100000) AND l_partkey % 10 IN (1, 3)"),
    "double_texts": (double_texts, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS t FROM ({_DOUBLES})"),
    "awkward_doubles": (
        awkward_doubles,
        "SELECT * FROM (VALUES (0, '0.03333333333333333'), (1, '0.30000000000000004'), (2, '0.3'), (3, '1e-7'), (4, '0.0000015'), (5, '1e+21'), (6, '125000000000000000000'), (7, '-123456789012.125'), (8, '0'), (9, '2e-308'), (10, '1.7976931348623157e+308')) t(i, t)",
    ),
    "double_keys": (double_keys, f"SELECT (SELECT count(DISTINCT x) FROM ({_DOUBLES})) AS distinct_x, count(*) AS groups, max(n) AS most FROM (SELECT x, count(*) AS n FROM ({_DOUBLES}) WHERE x <> 0.1 GROUP BY x)"),
}
for _op, (_values, _where) in _TESTS.items():
    for _spec, _suffix in ((ONE, ""), (OTHERS, "_keeping_others")):
        ENTRIES[f"value_map_{_snake(_op) if _op != 'gt' else 'unknown_operator'}{_suffix}"] = (_query([Filter(_op, values=_values, value_map=_spec)]), _sql(_where.format(m=f"({_mapped(_spec.keep_others)})")))
