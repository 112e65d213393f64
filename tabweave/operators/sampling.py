"""Samples that are the same on every run, and types inferred from them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalars import WHOLE, text_of, trimmed
from tabweave.operators.filters import column, schema_of

COLUMN_SAMPLE = 10


def sample_rank(seed: int | str, *keys: Column) -> Column:
    """A text that orders rows at random, but the same way each time."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def sample_rows(df: DataFrame, k: int, keys: Sequence[str], seed: int | str = 0) -> DataFrame:
    """k rows at random: those of the smallest hashes of their keys. Each task keeps k rows at most."""
    if k < 0:
        raise ValueError("a sample can't have fewer than no rows")
    return df.orderBy(sample_rank(seed, *(column(c) for c in keys)), *(column(c) for c in keys)).limit(k)


def sample_columns(df: DataFrame, keys: Sequence[str], k: int = COLUMN_SAMPLE, seed: int | str = 0) -> DataFrame:
    """For each column at most k values that aren't blank, as (column, value, place); each column has an order of its own."""
    schema = schema_of(df)
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), text_of(column(n), t).alias("value")) for n, t in schema.items() if n not in keys)))
    long = df.select(*(column(c).alias(f"__k{i}") for i, c in enumerate(keys)), cells.alias("__c")).select("__c.*", *(f"__k{i}" for i in range(len(keys))))
    ranked = long.where(trimmed(F.col("value")) != "").select("column", F.struct(sample_rank(seed, F.col("column"), *(F.col(f"__k{i}") for i in range(len(keys)))).alias("r"), F.col("value")).alias("x"))
    order = Window.partitionBy("column").orderBy("x")
    # Spark keeps the first k rows of each column and task before they meet
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("column", "x.value", "place")


_DATE = r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}"


def inferred_type(c: Column) -> Column:
    """An aggregate: integer, float, boolean, datetime or string, by all texts that aren't blank."""
    s = trimmed(c)
    there = c.isNotNull() & (s != "")
    every = lambda test: F.coalesce(F.bool_and(F.when(there, test)), F.lit(False))
    number = s.try_cast("double")
    numeric = s.rlike(WHOLE) & number.isNotNull()
    return (
        F.when(F.count_if(there) == 0, "string")
        .when(every(numeric), F.when(every(number == F.floor(number)), "integer").otherwise("float"))
        .when(every(F.lower(s).isin("true", "false")), "boolean")
        .when(every(s.rlike(_DATE)), "datetime")
        .otherwise("string")
    )


def inferred_types(df: DataFrame) -> DataFrame:
    """(column, type) of each column of texts, by one pass over df."""
    schema = schema_of(df)
    one = df.agg(*(inferred_type(text_of(column(n), t)).alias(n) for n, t in schema.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), column(n).alias("type")) for n in schema))).alias("x")).select("x.*")


def schema_summary(df: DataFrame) -> DataFrame:
    """(column, type, rows)."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    return inferred_types(df).crossJoin(total)  # a row for each column and one row


def discovered_columns(df: DataFrame) -> DataFrame:
    """(column, filled): every column that any row has, and how many rows have a value there."""
    schema = schema_of(df)
    one = df.agg(*(F.count(column(n)).alias(n) for n in schema))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), column(n).alias("filled")) for n in schema))).alias("x")).select("x.*")


def schema_hash(columns: Sequence[tuple[str, str]]) -> str:
    return hashlib.sha256("|".join(f"{n}:{t}" for n, t in columns).encode()).hexdigest()


def content_hash(columns: Sequence[tuple[str, str]], rows: int, size: int) -> str:
    text = "|".join(f"{n}:{t}" for n, t in columns)
    return hashlib.sha256(f"{text}|rows:{rows}|size:{size}".encode()).hexdigest()


def all_texts(df: DataFrame) -> DataFrame:
    """Every column as texts."""
    return df.select(*(text_of(column(f.name), f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else column(f.name) for f in df.schema.fields))
