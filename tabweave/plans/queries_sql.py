"""Queries over a source's view, requests by their lanes, and sequence regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators.aggregate import Aggregation, AggregationSpec, Order
from tabweave.operators.filters import Filter
from tabweave.operators.profile import Profile
from tabweave.operators.sequence_region import known_names, sequence_region
from tabweave.plans.inputs import CELLS_SQL, cells, leading_sql, table
from tabweave.plans.lanes import Request, agree, answer, run_sql, self_check
from tabweave.sources.files import SOURCE_VIEW

#: Statements over a table `src`, the same for Spark and the oracle.
VIEW: dict[str, tuple[str, str]] = {
    "sql_filter_project": ("orders", "SELECT o_orderkey, o_totalprice FROM src WHERE o_orderstatus = 'F' AND o_totalprice > 100000"),
    "sql_self_join": ("nation", "SELECT a.n_name AS name, b.n_name AS peer FROM src a JOIN src b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "sql_ranking": ("orders", "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM src"),
    "sql_running_count": ("orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM src"),
    "sql_lag": ("events", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM src"),
    "sql_union": ("nation", "SELECT n_regionkey AS x FROM src WHERE n_nationkey < 9 UNION SELECT n_nationkey FROM src WHERE n_nationkey > 20"),
    "sql_intersect": ("orders", "SELECT o_custkey FROM src WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM src WHERE o_orderstatus = 'O'"),
    "sql_except": ("orders", "SELECT o_custkey FROM src WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM src WHERE o_orderstatus = 'P'"),
    "sql_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM src GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM src GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "sql_grouping_sets": ("lineitem", "SELECT l_returnflag, l_shipdate, count(*) AS n FROM src GROUP BY GROUPING SETS ((l_returnflag), (l_shipdate))"),
    "sql_semi_join": ("customer", "SELECT c_custkey FROM src a WHERE EXISTS (SELECT 1 FROM src b WHERE b.c_nationkey = a.c_nationkey AND b.c_acctbal > a.c_acctbal + 9000)"),
    "sql_scalar_subquery": ("part", "SELECT p_partkey FROM src WHERE p_size > (SELECT avg(p_size) FROM src)"),
}
#: What Spark is given in place of a statement whose join it would run over all pairs of a group: some value is above a bound if the largest is.
LINEAR = {
    "sql_semi_join": "SELECT c_custkey FROM src a WHERE EXISTS (SELECT 1 FROM (SELECT c_nationkey, max(c_acctbal) AS most FROM src GROUP BY c_nationkey) b WHERE b.c_nationkey = a.c_nationkey AND b.most > a.c_acctbal + 9000)",
}


def _view(name: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(table(spark, sf_dir, name), sql.replace("src", SOURCE_VIEW))

    return run


ENTRIES = {n: (_view(t, LINEAR.get(n, s)), f"WITH src AS (SELECT * FROM {t}) {s}") for n, (t, s) in VIEW.items()}

_SPEC = AggregationSpec(["region"], [Aggregation("sum", "cost", "total"), Aggregation("count", "*", "n")])
_DETAIL = Request([Filter("equals", "region", ("EU",)), Filter("gt", "qty", (40,))], ["k", "qty", "nowhere"], order=[Order("price", True)], limit=50, offset=10, ties=("k",))


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(cells(spark, sf_dir), _DETAIL).data


def aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(cells(spark, sf_dir), Request([Filter("notSet", "vendor")], ["region"], _SPEC, limit=1)).data


def detail_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answer(cells(spark, sf_dir), Request(detail_sql=f"SELECT k, vendor FROM {SOURCE_VIEW} WHERE region = 'US'")).data
    return out.select(F.col("k.text").alias("k"), F.col("vendor.text").alias("vendor"))


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(cells(spark, sf_dir).select("k"), Request(expected_signature="a"), signature="b").data


def stale_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an answer whose source is as expected, and none of one that isn't, nor of an order by a field that isn't there."""
    df = cells(spark, sf_dir).select("k")
    asked = (("same", Request(expected_signature="a"), "a"), ("other", Request(expected_signature="a"), "b"), ("absent", Request(order=[Order("nowhere")]), None))
    found = [(n, answer(df, r, s)) for n, r, s in asked]
    rows = [(n, a.data.count(), a.diagnostics["signature_mismatch"], a.diagnostics["order_field_absent"]) for n, a in found]
    return spark.createDataFrame(rows, "request string, n long, signature_mismatch boolean, order_field_absent boolean")


_PLAIN = AggregationSpec(["region"], [Aggregation("sum", "whole", "total"), Aggregation("max", "lines", "most")])
_LOOSE = AggregationSpec(["region"], [Aggregation("sum", "cost", "total")])


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of clean cells and of loose ones, by their own rules and by plain casts; regions that aren't known count as misplaced."""
    df = cells(spark, sf_dir).withColumn("whole", F.col("lines").cast("string"))
    profiles = {"region": Profile("string", enum_values=("APAC", "EU", "US"), sample_size=9)}
    rows = []
    for name, spec, filters in (("clean", _PLAIN, [Filter("notEquals", "region", ("Unknown",))]), ("loose", _LOOSE, [])):
        s = self_check(df, Request(filters, aggregation=spec), profiles)
        rows.append((name, s.aggregate_verified, s.dirty_casts, s.realigned, s.suspected, s.total, s.realignment_clean))
    return spark.createDataFrame(rows, "request string, verified boolean, dirty_casts long, realigned long, suspected long, total long, clean boolean")


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate by the compiler and by SQL, and another one."""
    df = cells(spark, sf_dir)
    ours = answer(df, Request(aggregation=AggregationSpec(["region"], [Aggregation("count", "vendor", "n")]))).data
    statements = {"same": "count(vendor)", "other": "count(*)"}
    return spark.createDataFrame([(n, agree(spark, ours, run_sql(df, f"SELECT region, {e} AS n FROM {SOURCE_VIEW} GROUP BY region"))) for n, e in statements.items()], "what string, agree boolean")


def null_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate by vendors, some of which are null, of each region's rows as if read from files of two kinds."""
    df, rows = cells(spark, sf_dir), []
    for region in ("EU", "US"):
        for source in ("cells.csv", "cells.parquet"):
            for by in ("vendor", "region"):
                told = answer(df, Request([Filter("equals", "region", (region,))], aggregation=AggregationSpec([by], [Aggregation("count", "*", "n")])), source=source).diagnostics
                rows.append((region, source, by, told["null_group_rows"], told["must_decline"]))
    return spark.createDataFrame(rows, "region string, source string, grouped_by string, null_group_rows long, must_decline boolean")


def proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of a sum of clean cells, held against other requests and another source."""
    df = cells(spark, sf_dir).withColumn("whole", F.col("lines").cast("string"))
    asked = lambda kind, by="region": AggregationSpec([by], [Aggregation(kind, "whole", "total")])
    proof = self_check(df, Request(aggregation=asked("sum")), {}, "a")
    cases = {"same": (asked("sum"), "a"), "mean": (asked("avg"), "a"), "other groups": (asked("sum", "vendor"), "a"), "other source": (asked("sum"), "b")}
    rows = [(n, proof.dirty_casts, answer(df, Request(aggregation=spec, proof=proof), s).diagnostics["verified"]) for n, (spec, s) in cases.items()]
    return spark.createDataFrame(rows, "request string, dirty_casts long, verified boolean")


def names_to_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a request for an unknown sequence is answered with."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS __row_idx", "p_brand AS brand", "'Sample ' || CAST(p_partkey % 50 AS STRING) AS sample_label")
    return known_names(rows)


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS __row_idx", "'Sample ' || CAST(p_partkey % 50 AS STRING) AS sample", "p_brand", "repeat(substring('ACGTN', CAST(p_partkey % 5 AS INT) + 1, 1) || 'acgt', 60 + CAST(p_partkey % 7 AS INT)) AS bases")
    return sequence_region(rows, "sample 17", start=150, end=200).select("sequence_column", "total_length", "region_start", "region_end", "region_length", "sequence", "has_more", "next_start", F.col("metadata")["p_brand"].alias("brand"))


ENTRIES |= {
    "lane_detail": (detail, f"WITH {CELLS_SQL} SELECT k, qty FROM c WHERE region = 'EU' AND qty > 40 ORDER BY price DESC, k LIMIT 50 OFFSET 10"),
    "lane_aggregation": (aggregation, f"WITH {CELLS_SQL} SELECT region, coalesce(sum(coalesce({leading_sql('cost')}, 0)), 0) AS total, count(*) AS n FROM c WHERE vendor IS NULL OR vendor = '' GROUP BY 1"),
    "lane_detail_sql": (detail_sql, f"WITH {CELLS_SQL} SELECT k, trim(coalesce(vendor, '')) AS vendor FROM c WHERE region = 'US'"),
    "lane_stale_signature": (stale, f"WITH {CELLS_SQL} SELECT k FROM c WHERE FALSE"),
    "lane_signatures": (stale_or_not, "SELECT 'same' AS request, least(count(*), 10000) AS n, FALSE AS signature_mismatch, FALSE AS order_field_absent FROM lineitem UNION ALL SELECT 'other', 0, TRUE, FALSE UNION ALL SELECT 'absent', 0, FALSE, TRUE"),
    "sequence_names": (names_to_choose, "SELECT 'Sample ' || CAST(p_partkey % 50 AS VARCHAR) AS name FROM part ORDER BY p_partkey LIMIT 20"),
    "lane_null_gate": (
        null_gate,
        f"WITH {CELLS_SQL}, n AS (SELECT region, count(*) FILTER (vendor IS NULL) AS n FROM c WHERE region IN ('EU', 'US') GROUP BY region) SELECT region, source, grouped_by, CASE WHEN grouped_by = 'vendor' THEN n ELSE 0 END AS null_group_rows, grouped_by = 'vendor' AND n > 0 AND source LIKE '%.parquet' AS must_decline FROM n, (VALUES ('cells.csv'), ('cells.parquet')) s(source), (VALUES ('vendor'), ('region')) g(grouped_by)",
    ),
    "lane_proofs": (proofs, "SELECT r AS request, count(*) FILTER (l_linenumber IS NULL) AS dirty_casts, r = 'same' AND count(*) > 0 AS verified FROM lineitem, (VALUES ('same'), ('mean'), ('other groups'), ('other source')) t(r) GROUP BY r"),
    "lane_self_check": (agreements, f"WITH {CELLS_SQL} SELECT 'same' AS what, TRUE AS agree UNION ALL SELECT 'other', count(*) = count(vendor) FROM c"),
    "self_check": (
        checked,
        f"""
WITH {CELLS_SQL}, d AS (SELECT count(*) AS n, count(*) FILTER (({leading_sql('cost')}) IS DISTINCT FROM TRY_CAST(CASE WHEN cost <> '0x10' THEN trim(cost) END AS DOUBLE) AND cost <> 'TRUE' OR cost = '0x10') AS dirty FROM c)
SELECT 'clean' AS request, TRUE AS verified, CAST(0 AS BIGINT) AS dirty_casts, CAST(0 AS BIGINT) AS realigned, CAST(0 AS BIGINT) AS suspected, n AS total, TRUE AS clean FROM d
UNION ALL SELECT 'loose', FALSE, dirty, 0, 0, n, TRUE FROM d""",
    ),
    "sequence_region": (
        region,
        """
WITH p AS (SELECT p_partkey, p_brand, repeat(substring('ACGTN', CAST(p_partkey % 5 AS INT) + 1, 1) || 'acgt', 60 + CAST(p_partkey % 7 AS INT)) AS s FROM part WHERE p_partkey % 50 = 17 ORDER BY p_partkey LIMIT 1),
w AS (SELECT *, 50 AS a, CAST(least(length(s), 300) AS INTEGER) AS b FROM p)
SELECT 'bases' AS sequence_column, CAST(length(s) AS INTEGER) AS total_length, a AS region_start, b AS region_end, b - a AS region_length, substring(s, a + 1, b - a) AS sequence, b < length(s) AS has_more, b - 100 AS next_start, p_brand AS brand FROM w""",
    ),
}
