"""Tables for the queries: the driver's tables as they are, and one of loosely typed cells made from line items.

The expressions are read by Spark and by the oracle alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabweave.functions.scalars import LEADING, WHOLE

CELLS = {
    "k": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)",
    "vendor": "CASE l_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' Sigma ' WHEN 3 THEN 'NEB' WHEN 4 THEN 'Sigma-Aldrich [USA]' ELSE 'Vendor ' || CAST(l_suppkey % 5 AS STRING) END",
    "region": "CASE l_partkey % 4 WHEN 0 THEN 'EU' WHEN 1 THEN 'US' WHEN 2 THEN 'APAC' ELSE 'Unknown' END",
    "cost": "CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'n/a' WHEN 3 THEN CAST(l_partkey AS STRING) || ' kg' WHEN 4 THEN '1e3' WHEN 5 THEN ' 42 ' WHEN 6 THEN '1,234' WHEN 7 THEN '0x10' WHEN 8 THEN 'TRUE' WHEN 9 THEN '-' || CAST(l_suppkey AS STRING) || '.5' ELSE CAST(l_partkey AS STRING) END",
    "placed": "CASE l_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "lines": "l_linenumber",
    "flag": "l_returnflag",
    "shipped": "l_shipdate",
}
#: The same for the oracle.
CELLS_SQL = "c AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CELLS.items()) + " FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in CELLS.items()))


def leading_sql(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{LEADING}', 1), '') AS DOUBLE)"


def number_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 0 WHEN regexp_matches(trim({x}), '{WHOLE}') THEN TRY_CAST(trim({x}) AS DOUBLE) WHEN {x} = '0x10' THEN 16 END"


def text_sql(x: str) -> str:
    """For doubles."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
