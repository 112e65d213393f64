"""Order and pages: nulls last both ways, dates by time, numbers by value, texts by collation, ties by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalars import instant_of, is_blank, is_iso_date, leading_number, text_of
from tabweave.operators.aggregate import Order
from tabweave.operators.filters import column, schema_of
from tabweave.session import scratch

DEFAULT_LIMIT = 10_000
#: Pages that end further in are cut from a written order.
TOP_ROWS = 20_000
ROW, PLACE = "__row_idx", "__place"


def sort_values(name: str, kind: T.DataType) -> list[Column]:
    """What a field is sorted by, in turn, of cells that aren't null: dates before numbers before other texts, each in its own order."""
    cell = column(name)
    if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [cell]
    text = text_of(cell, kind)
    instant, number = instant_of(text), leading_number(text)
    class_ = F.when(instant.isNotNull(), 0).when(number.isNotNull(), 1).when(text.isNotNull(), 2)
    return [class_, F.coalesce(instant, number), F.when(class_ == 2, F.collate(text, "UNICODE"))]


def ordered(df: DataFrame, order: Sequence[Order], ties: Sequence[str] = (ROW,)) -> DataFrame:
    """df in an order, nulls last both ways. What rows are sorted by is computed once for each, not for each comparison."""
    schema, keys, made = schema_of(df), [], {}
    for i, o in enumerate(order):
        if o.field not in schema:
            continue
        keys.append(column(o.field).isNull().asc())
        values = sort_values(o.field, schema[o.field])
        if len(values) > 1:
            made |= {f"__sort_{i}_{k}": v for k, v in enumerate(values)}
            values = [F.col(f"__sort_{i}_{k}") for k in range(len(values))]
        keys += [v.desc_nulls_last() if o.descending else v.asc_nulls_last() for v in values]
    keys += [column(t).asc() for t in ties if t in schema]
    out = df.withColumns(made) if made else df
    return (out.orderBy(*keys) if keys else out).drop(*made)


def top_page(df: DataFrame, order: Sequence[Order], limit: int | None = None, offset: int | None = None, ties: Sequence[str] = (ROW,)) -> DataFrame:
    """Rows offset to offset + limit of the order. No limit, or 0, means DEFAULT_LIMIT.

    Up to TOP_ROWS rows in, Spark keeps only so many rows in each task and merges them. Deeper pages are cut from the
    whole order, which is sorted by ranges and written to the shared folder when the page is asked for.
    """
    first, n = offset or 0, limit or DEFAULT_LIMIT
    if first + n <= TOP_ROWS:
        return ordered(df, order, ties).offset(first).limit(n)
    return _deep_page(ordered(df, order, ties), first, n)


def _deep_page(sorted_df: DataFrame, first: int, n: int) -> DataFrame:
    """A row's number tells its range and its place there; counts of the ranges, a row each, tell where the page lies."""
    spark = sorted_df.sparkSession
    path = f"{scratch(spark, 'order')}/t"
    sorted_df.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
    held = spark.read.parquet(path)
    ranges = held.groupBy(F.shiftright(PLACE, 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()
    at, low, high = 0, None, None
    for r in ranges:
        if low is None and at + r.n > first:
            low = (r.range << 33) + first - at
        if at < first + n:
            high = (r.range << 33) + min(r.n, first + n - at)
        at += r.n
    page = held.where(F.lit(False)) if low is None else held.where((F.col(PLACE) >= low) & (F.col(PLACE) < high))
    return page.orderBy(PLACE).drop(PLACE)


#: Rows of a run that is counted, as powers of two: first long runs, then short ones within those that hold the page.
SEEK = (26, 14)


def page(df: DataFrame, limit: int | None = None, offset: int | None = None, ties: Sequence[str] = (ROW,), top_rows: int = TOP_ROWS) -> DataFrame:
    """A page in row order. Beyond `top_rows` rows, a page by row places is sought by counts, without a sort of what comes before it."""
    first, n = offset or 0, limit or DEFAULT_LIMIT
    if first + n > top_rows and tuple(ties) == (ROW,) and ROW in df.columns:
        return _sought(df, first, n)
    return top_page(df, (), limit, offset, ties)


def _sought(df: DataFrame, first: int, n: int) -> DataFrame:
    """The rows left in each run of places are counted, which tells the runs that hold the page; only their rows are read then.

    The driver gets a row for each long run, and for each short one of those that hold the page's ends and what is between.
    """
    low, high, before = 0, None, 0
    for bits in SEEK:
        held = df.where(F.col(ROW) >= low) if high is None else df.where((F.col(ROW) >= low) & (F.col(ROW) < high))
        runs = held.groupBy(F.shiftright(F.col(ROW).cast("long"), bits).alias("run")).agg(F.count(F.lit(1)).alias("n")).orderBy("run").collect()
        begin, at = None, before
        for r in runs:
            if begin is None and at + r.n > first:
                begin, before = r.run, at
            if begin is not None and at < first + n:
                low, high = begin << bits, (r.run + 1) << bits
            at += r.n
        if begin is None:
            return df.where(F.lit(False))
    return df.where((F.col(ROW) >= low) & (F.col(ROW) < high)).orderBy(ROW).offset(first - before).limit(n)


def is_safe_sort_value(c: Column, kind: T.DataType | None = None) -> Column:
    """Blank, or a number that isn't the beginning of a date: such values sort alike everywhere."""
    text = text_of(c, kind)
    return is_blank(c, kind) | (~is_iso_date(text) & leading_number(text).isNotNull())


def sort_problem(df: DataFrame, order: Sequence[Order]) -> DataFrame:
    """One row: whether a field of the order is missing, and whether any of its values doesn't sort alike everywhere."""
    schema = schema_of(df)
    unsafe = F.lit(False)
    for o in order:
        if o.field in schema:
            unsafe = unsafe | ~is_safe_sort_value(column(o.field), schema[o.field])
    return df.agg(F.lit(any(o.field not in schema for o in order)).alias("missing_field"), F.coalesce(F.bool_or(unsafe), F.lit(False)).alias("unsafe_value"))
