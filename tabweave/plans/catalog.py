"""Every query of the library by name, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabweave.plans import queries_aggregate, queries_filters, queries_order, queries_profile, queries_sources, queries_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_aggregate, queries_filters, queries_order, queries_sources, queries_profile, queries_sql):
    for _name, (_query, _sql) in _module.ENTRIES.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
