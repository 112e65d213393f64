"""Aggregation of loosely typed columns: groups, grand totals, truncated dates and counters of blanks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalars import is_blank, leading_number, text_of
from tabweave.operators.filters import Schema, column, schema_of

UNKNOWN = "Unknown"
GRAINS = ("day", "week", "month", "quarter", "year")
EVERY_ROW = ("*", "1")


@dataclass(frozen=True)
class Aggregation:
    type: str
    column: str
    alias: str
    distinct: bool = False


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class AggregationSpec:
    """date_truncs: a grain for some of the columns in group_by; null_group: what stands for null there."""

    group_by: Sequence[str] = ()
    aggregations: Sequence[Aggregation] = ()
    date_truncs: dict[str, str] = field(default_factory=dict)
    order_by: Sequence[Order] = ()
    limit: int | None = None
    null_group: str = UNKNOWN


def _cell(name: str, schema: Schema) -> tuple[Column, T.DataType]:
    kind = schema.get(name)
    return (column(name), kind) if kind is not None else (F.lit(None).cast("string"), T.StringType())


def aggregate(a: Aggregation, schema: Schema) -> Column:
    """One measure. Sums and means read leading numbers and take other texts as zero; means leave out blank cells;
    least and largest leave out what has no leading number; distinct counts take null and blank as one value."""
    cell, kind = _cell(a.column, schema)
    number = leading_number(cell, kind)
    filled = ~is_blank(cell, kind)
    if a.type == "count":
        if a.column in EVERY_ROW:
            return F.count(F.lit(1))
        if a.distinct:
            return F.count_distinct(F.coalesce(text_of(cell, kind), F.lit("")))
        return F.count(cell)
    if a.type == "sum":
        return F.sum(F.coalesce(number, F.lit(0.0)))
    if a.type == "avg":
        return F.try_divide(F.sum(F.when(filled, F.coalesce(number, F.lit(0.0)))), F.count_if(filled))
    if a.type == "min":
        return F.min(number)
    if a.type == "max":
        return F.max(number)
    raise ValueError(f"unknown aggregation: {a.type}")


def truncated(cell: Column, kind: T.DataType, grain: str) -> Column:
    """A date's day, week (from Monday), month, quarter or year, without a zone; null for what is no date."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    when = cell if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.try_to_timestamp(cell.cast("string"))
    return F.date_trunc(grain, when).cast("timestamp_ntz")


def group_key(name: str, spec: AggregationSpec, schema: Schema) -> Column:
    cell, kind = _cell(name, schema)
    if name in spec.date_truncs:
        return truncated(cell, kind, spec.date_truncs[name])
    return F.coalesce(text_of(cell, kind), F.lit(spec.null_group))


def aggregated(df: DataFrame, spec: AggregationSpec) -> DataFrame:
    """One row for each group, or one for all rows if there are any; no rows give no rows.

    Keys are structural, so values that hold a separator don't meet. Spark sums in part before it shuffles.
    """
    schema = schema_of(df)
    measures = [aggregate(a, schema).alias(a.alias) for a in spec.aggregations]
    if spec.group_by:
        out = df.groupBy(*(group_key(g, spec, schema).alias(g) for g in spec.group_by)).agg(*(measures or [F.count(F.lit(1)).alias("__n")]))
        out = out if measures else out.drop("__n")
    else:
        out = df.agg(*measures, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
    if spec.order_by:
        out = out.orderBy(*((column(o.field).desc_nulls_last() if o.descending else column(o.field).asc_nulls_last()) for o in spec.order_by))
    return out.limit(spec.limit) if spec.limit is not None else out


def null_measure_rows(spec: AggregationSpec, schema: Schema, keep: Column) -> Column:
    """The largest number of blank cells among the measures' columns, of rows on which keep holds."""
    counts = [F.count_if(keep & is_blank(*_cell(a.column, schema))) for a in spec.aggregations if a.column not in EVERY_ROW]
    return F.coalesce(F.greatest(*counts) if len(counts) > 1 else counts[0], F.lit(0)) if counts else F.lit(0).cast("long")


def null_group_rows(spec: AggregationSpec, schema: Schema, keep: Column) -> Column:
    """Rows on which keep holds with a null, not merely blank, in a grouped or distinctly counted column."""
    names = [*spec.group_by, *(a.column for a in spec.aggregations if a.distinct and a.column not in EVERY_ROW)]
    held = F.lit(False)
    for n in dict.fromkeys(names):
        held = held | _cell(n, schema)[0].isNull()
    return F.count_if(keep & held)


def counters(df: DataFrame, keep: Column, spec: AggregationSpec) -> DataFrame:
    """One row, by one pass: source_rows, filtered_rows, null_measure_rows, null_group_rows; the last three of rows on which keep holds."""
    schema = schema_of(df)
    return df.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(keep).alias("filtered_rows"), null_measure_rows(spec, schema, keep).alias("null_measure_rows"), null_group_rows(spec, schema, keep).alias("null_group_rows"))


def must_decline(source: str, null_groups: int) -> bool:
    """A source that can hold nulls (not CSV or TSV, whose blank cells are texts) and holds one among its groups."""
    return source.lower().rpartition(".")[2] in ("json", "parquet") and null_groups > 0
