"""The driver's contract: names, the smoke query, and SQL twins on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tabweave.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    there = importlib.util.find_spec("tabweave.llm")
    assert bool(there and there.origin) == any(n.startswith("op1_") for n in entry.queries())


def test_smoke(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL)))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, str(DATA))
    result = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda rows: sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in sorted(columns)]) for r in rows)
    assert plain(r.asDict() for r in df.collect()) == plain(dict(zip(columns, r, strict=True)) for r in result.fetchall())
