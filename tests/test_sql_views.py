"""Statements that Spark is given in another form than the oracle."""

import math

from tabweave.plans.lanes import run_sql
from tabweave.plans.queries_sql import ENTRIES, LINEAR, VIEW
from tabweave.sources.files import SOURCE_VIEW


def test_semi_join_compares_with_one_row_a_nation(spark, tmp_path):
    balances = [None, math.nan, math.inf, -math.inf, -999.85, -500.0, 0.0, 500.0, 8500.0, 9999.8]
    rows = [(k, nation, x) for k, (nation, x) in enumerate((n, x) for n in (None, 0, 1, 2, 3) for x in balances if n != 1 or x is None or x < 0 for _ in range(1 + (n == 2)) if n != 3 or x is None or not x > 8000)]
    df = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double")
    df.write.parquet(f"{tmp_path}/customer.parquet")
    found = ENTRIES["sql_semi_join"][0](spark, str(tmp_path))
    want = run_sql(df, VIEW["sql_semi_join"][1].replace("src", SOURCE_VIEW))
    assert sorted(r.c_custkey for r in found.collect()) == sorted(r.c_custkey for r in want.collect()) != []
    # what is joined is a nation's largest balance, not every customer of the nation
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "max(c_acctbal" in plan and set(LINEAR) <= set(VIEW)
