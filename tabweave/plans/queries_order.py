"""Queries for order, pages, projection, renaming and cell values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.normalize import column_name_of
from tabweave.functions.scalars import leading_number, number_of, text_of
from tabweave.operators.aggregate import Order
from tabweave.operators.filters import Filter, apply_filters, schema_of
from tabweave.operators.order_page import ROW, is_safe_sort_value, page, sort_problem, top_page
from tabweave.operators.project import PlanItem, coerced, coerced_sample, normalize_columns, select_present, transform_columns
from tabweave.plans.inputs import CELLS_SQL, cells, leading_sql, number_sql, table, text_sql

_N = leading_sql("cost")
_WHEN = "try_strptime(placed, '%Y-%m-%d')"


def _top(order: list[Order], limit: int | None = 20, offset: int | None = 0, filters: tuple = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return top_page(apply_filters(cells(spark, sf_dir), filters), order, limit, offset, ties=("k",)).select("k")

    return run


def _sql(order: str, limit: int = 20, offset: int = 0, where: str = "TRUE") -> str:
    return f"WITH {CELLS_SQL} SELECT k FROM c WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


_NUMERIC = (Filter("contains", "cost", ("1", "2", "5")),)
_DATES = (Filter("gt", "placed", ("1900-01-01",)),)
ENTRIES = {
    "top_numeric_desc": (_top([Order("qty", True)]), _sql("qty DESC, k")),
    "top_numeric_asc_offset": (_top([Order("qty"), Order("price", True)], 25, 40), _sql("qty, price DESC, k", 25, 40)),
    "top_text_numbers": (_top([Order("cost", True)], 50, 0, _NUMERIC), _sql(f"{_N} DESC, k", 50, 0, "regexp_matches(cost, '[125]') AND cost NOT IN ('n/a', 'TRUE')")),
    "top_dates": (_top([Order("placed")], 30, 5, _DATES), _sql(f"{_WHEN}, k", 30, 5, f"{_WHEN} > TIMESTAMP '1900-01-01'")),
    "top_texts_nulls_last": (_top([Order("vendor", True), Order("region")], 3000, 58000), _sql("vendor DESC NULLS LAST, lower(region), k", 3000, 58000)),
    "top_timestamps": (_top([Order("shipped", True), Order("lines")], 40), _sql("shipped DESC, lines, k", 40)),
    "top_one": (_top([Order("price", True)], 1), _sql("price DESC, k", 1)),
    "top_texts_deep": (_top([Order("vendor", True), Order("cost")], 500, 21_000), _sql(f"vendor DESC NULLS LAST, cost IS NULL, {_N} IS NULL, {_N}, CASE WHEN {_N} IS NULL THEN lower(cost) END, k", 500, 21_000)),
    "top_missing_field": (_top([Order("nowhere"), Order("qty")], 10), _sql("qty, k", 10)),
}


def plain_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(apply_filters(cells(spark, sf_dir), [Filter("equals", "region", ("EU",))]), 100, 250, ties=("k",)).select("k", "region")


def sought_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far into the orders of a status, found by counts of runs of row places."""
    df = table(spark, sf_dir, "orders").withColumn(ROW, F.col("o_orderkey"))
    return page(apply_filters(df, [Filter("equals", "o_orderstatus", ("O",))]), 100, 1500, top_rows=1000).select("o_orderkey", "o_orderpriority")


def default_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(cells(spark, sf_dir), 0, None, ties=("k",)).select("k")


def safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cells(spark, sf_dir)
    return df.groupBy("region").agg(*(F.count_if(is_safe_sort_value(F.col(c), schema_of(df)[c])).alias(c) for c in ("vendor", "cost", "placed", "qty")))


def problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_problem(cells(spark, sf_dir), [Order("cost"), Order("nowhere")])


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_present(cells(spark, sf_dir), ["qty", "nowhere", "k", "vendor"])


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws(" - ", "p_brand", F.concat(F.initcap("p_type"), F.lit("Type"), F.col("p_type")), F.concat(F.lit("_"), F.initcap("p_name"), F.lit("ID_")))
    return table(spark, sf_dir, "part").select("p_partkey", column_name_of(F.concat(F.lit("sampleTypeID Percent_Q30 HTMLParser"), raw)).alias("name"))


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "region").selectExpr("r_regionkey AS `Region Key`", "r_name AS regionName", "r_regionkey + 1 AS region_key")
    return normalize_columns(df)


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [PlanItem("C_NAME", "name"), PlanItem("acctbal", "balance"), PlanItem("c_mktsegment"), PlanItem("nothing_like_it", "missing"), PlanItem("cnationkey", "nation")]
    return transform_columns(table(spark, sf_dir, "customer"), plan, tag=("batch", "b1"))


def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("k", coerced(F.col("cost")).alias("c")).select("k", "c.*")


def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("k", coerced_sample(F.col("cost")).alias("c")).select("k", "c.*")


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cells(spark, sf_dir)
    kinds = schema_of(df)
    return df.select("k", number_of(F.col("cost")).alias("whole"), leading_number(F.col("cost")).alias("leading"), text_of(F.col("qty"), kinds["qty"]).alias("qty_text"), text_of(F.col("price"), kinds["price"]).alias("price_text"))


_T = "trim(cost)"
_NUM = f"CASE WHEN cost IS NULL OR {_T} = '' OR upper({_T}) = 'TRUE' THEN NULL ELSE {number_sql('cost')} END"
_NAME = "'sampleTypeID Percent_Q30 HTMLParser' || p_brand || ' - ' || p_type_c || 'Type' || p_type || ' - ' || '_' || p_name_c || 'ID_'"
_STEP = "regexp_replace(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g')"
_CAP = "list_aggregate(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
ENTRIES |= {
    "page_filtered": (plain_page, f"WITH {CELLS_SQL} SELECT k, region FROM c WHERE region = 'EU' ORDER BY k LIMIT 100 OFFSET 250"),
    "page_sought": (sought_page, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100 OFFSET 1500"),
    "page_default": (default_page, f"WITH {CELLS_SQL} SELECT k FROM c ORDER BY k LIMIT 10000"),
    "sort_safety": (
        safety,
        f"WITH {CELLS_SQL} SELECT region, count(*) FILTER (vendor IS NULL OR vendor = '') AS vendor, count(*) FILTER (cost IS NULL OR cost = '' OR {_N} IS NOT NULL) AS cost, count(*) FILTER (placed IS NULL OR placed = '') AS placed, count(*) AS qty FROM c GROUP BY 1",
    ),
    "sort_problem": (problem, "SELECT TRUE AS missing_field, TRUE AS unsafe_value"),
    "project_present": (projection, f"WITH {CELLS_SQL} SELECT qty, k, vendor FROM c"),
    "normalize_names": (
        names,
        f"WITH p AS (SELECT *, {_CAP.format('p_type')} AS p_type_c, {_CAP.format('p_name')} AS p_name_c FROM part) SELECT p_partkey, regexp_replace(regexp_replace(lower({_STEP.format(_NAME)}), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM p",
    ),
    "rename_distinct": (renamed, "SELECT r_regionkey AS region_key, r_name AS region_name, r_regionkey + 1 AS region_key_1 FROM region"),
    "transform_by_plan": (transformed, "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment, CAST(NULL AS VARCHAR) AS missing, c_nationkey AS nation, 'b1' AS batch FROM customer"),
    "coerce_cells": (
        cell_values,
        f"WITH {CELLS_SQL} SELECT k, CASE WHEN cost IS NOT NULL AND ({_NUM}) IS NULL AND upper({_T}) <> 'TRUE' THEN {_T} END AS text, {_NUM} AS number, CASE WHEN upper({_T}) = 'TRUE' THEN TRUE END AS flag FROM c",
    ),
    "coerce_samples": (
        sample_values,
        f"WITH {CELLS_SQL} SELECT k, CASE WHEN cost IS NOT NULL AND {_T} <> '' AND upper({_T}) <> 'TRUE' AND NOT regexp_matches({_T}, '^-?[0-9]+(\\.[0-9]*)?$') THEN {_T} END AS text, CASE WHEN regexp_matches({_T}, '^-?[0-9]+(\\.[0-9]*)?$') THEN CAST({_T} AS DOUBLE) END AS number, CASE WHEN upper({_T}) = 'TRUE' THEN TRUE END AS flag FROM c",
    ),
    "scalar_rules": (scalars, f"WITH {CELLS_SQL} SELECT k, {number_sql('cost')} AS whole, {_N} AS leading, {text_sql('qty')} AS qty_text, {text_sql('price')} AS price_text FROM c"),
}
