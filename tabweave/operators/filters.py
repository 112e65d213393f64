"""Filters: a list of conditions on columns, all of which must hold, as one Spark predicate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalars import ISO_DATE, instant_of, is_blank, number_of, number_of_value, text_of, text_of_value, trimmed

#: A map of more entries is joined as a table rather than put into the plan as a literal.
MOST_LITERALS = 200
#: Entries of a table that are put into one partition.
ENTRIES_PER_PART = 100_000


@dataclass(frozen=True)
class ValueMap:
    """Replaces a column's values: the key is the value without outer blanks, in small letters.

    A value without an entry becomes null, or stays as it is with `keep_others`. Of repeated keys the last counts.
    """

    column: str
    pairs: Sequence[tuple[str, str]]
    keep_others: bool = False

    def entries(self) -> dict[str, str]:
        return dict(self.pairs)


@dataclass(frozen=True)
class Filter:
    """One condition: `values` are alternatives; comparisons of order take the first alone."""

    operator: str
    column: str | None = None
    values: tuple = ()
    value_map: ValueMap | None = None


Schema = Mapping[str, T.DataType]


def schema_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def _key(spec: ValueMap, schema: Schema) -> Column:
    return F.lower(trimmed(text_of(column(spec.column), schema[spec.column])))


def _chosen(spec: ValueMap, schema: Schema, hit: Column) -> Column:
    """The entry that was hit, or what stands for values without one; null for blank cells."""
    raw, kind = column(spec.column), schema[spec.column]
    other = text_of(raw, kind) if spec.keep_others else F.lit(None).cast("string")
    return F.when(~is_blank(raw, kind), F.coalesce(hit, other))


def mapped_value(spec: ValueMap, schema: Schema) -> Column:
    """The replaced value of each row; null for blank cells. A map of more than MOST_LITERALS entries needs `prepared`."""
    if spec.column not in schema:
        return F.lit(None).cast("string")
    entries = spec.entries()
    if len(entries) > MOST_LITERALS:
        raise ValueError(f"a value map of {len(entries)} entries is joined by apply_filters or prepared, not written into a plan")
    hit = F.lit(None).cast("string")
    if entries:
        hit = F.try_element_at(F.create_map(*(F.lit(x) for kv in entries.items() for x in kv)), _key(spec, schema))
    return _chosen(spec, schema, hit)


def entry_table(spark: SparkSession, spec: ValueMap, key: str, value: str) -> DataFrame:
    """A map's entries as a table of one row for each key, whose size Spark knows."""
    rows = list(spec.entries().items())
    df = spark.createDataFrame(rows, f"`{key}` string, `{value}` string")
    return df.repartition(-(-len(rows) // ENTRIES_PER_PART), key) if len(rows) > ENTRIES_PER_PART else df


def prepared(df: DataFrame, filters: Sequence[Filter]) -> tuple[DataFrame, Column]:
    """df with a column for each large value map, and the condition that every filter holds.

    A large map is joined by its keys, each of which it has once, so no row is lost or repeated. Spark broadcasts it if it
    is small enough for that, else both sides are dealt by the key.
    """
    schema, keep = schema_of(df), F.lit(True)
    for f, name in zip(filters, _names(df), strict=False):
        spec = f.value_map
        if spec is None or spec.column not in schema or len(spec.entries()) <= MOST_LITERALS:
            keep = keep & predicate(f, schema)
            continue
        table = entry_table(df.sparkSession, spec, f"{name}_key", f"{name}_hit")
        df = df.withColumn(name, _key(spec, schema)).join(table, F.col(name) == F.col(f"{name}_key"), "left").drop(name, f"{name}_key")
        keep = keep & _on_map(f, _chosen(spec, schema, F.col(f"{name}_hit")))
    return df, keep


def _names(df: DataFrame) -> Iterator[str]:
    """Names that df doesn't have."""
    taken, i = {c.lower() for c in df.columns}, 0
    while True:
        if not any(c.startswith(f"__map{i}") for c in taken):
            yield f"__map{i}"
        i += 1


def _any(values: Iterable[str], test: Callable[[str], Column]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def _text_tests(text: Column, values: Sequence[str]) -> dict[str, Column]:
    """Tests of a text without nulls by the name of their positive form."""
    low = F.lower(text)
    return {
        "equals": text.isin(*values) if values else F.lit(False),
        "contains": _any(values, lambda v: F.contains(low, F.lit(v.lower()))),
        "startsWith": _any(values, lambda v: F.startswith(low, F.lit(v.lower()))),
        "endsWith": _any(values, lambda v: F.endswith(low, F.lit(v.lower()))),
    }


_NEGATIONS = {"notEquals": "equals", "notContains": "contains", "notStartsWith": "startsWith", "notEndsWith": "endsWith"}
_ORDERS: dict[str, Callable[[Column, Column], Column]] = {"gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "gte": lambda a, b: a >= b, "lte": lambda a, b: a <= b}


def _on_map(f: Filter, value: Column) -> Column:
    there = value.isNotNull() & (value != "")
    if f.operator in ("set", "notSet"):
        return F.coalesce(there, F.lit(False)) if f.operator == "set" else ~F.coalesce(there, F.lit(False))
    tests = _text_tests(value, [text_of_value(v) for v in f.values])
    if f.operator in tests:
        return F.coalesce(tests[f.operator], F.lit(False))
    if f.operator in _NEGATIONS:
        return ~F.coalesce(tests[_NEGATIONS[f.operator]], F.lit(False))
    return F.lit(True)


def _ordered(f: Filter, cell: Column, kind: T.DataType | None) -> Column:
    import re

    first = f.values[0] if f.values else None
    compare = _ORDERS[f.operator]
    if re.match(ISO_DATE, text_of_value(first)):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            held = F.unix_micros(cell.cast("timestamp")) / 1e6
        else:
            held = instant_of(text_of(cell, kind))
        return F.coalesce(compare(held, instant_of(F.lit(text_of_value(first)))), F.lit(False))
    number = number_of_value(first) if f.values else None
    if number is None or kind is None:
        return F.lit(False)
    return F.coalesce(compare(number_of(cell, kind), F.lit(number)), F.lit(False))


def predicate(f: Filter, schema: Schema) -> Column:
    """A condition without nulls. A null cell reads as the text `null`, a missing column as `undefined`.

    An operator that isn't known keeps the row. `notStartsWith` and `notEndsWith` on a plain column are carried out.
    """
    if f.value_map is not None:
        return _on_map(f, mapped_value(f.value_map, schema))
    kind = schema.get(f.column or "")
    cell = column(f.column) if kind is not None else F.lit(None).cast("string")
    if f.operator in ("set", "notSet"):
        blank = is_blank(cell, kind)
        return ~blank if f.operator == "set" else blank
    if f.operator in _ORDERS:
        return _ordered(f, cell, kind)
    values = [text_of_value(v) for v in f.values]
    text = F.coalesce(text_of(cell, kind), F.lit("null" if kind is not None else "undefined"))
    tests = _text_tests(text, values)
    if f.operator in tests:
        return tests[f.operator]
    if f.operator == "notEquals":
        return ~tests["equals"]
    if f.operator in _NEGATIONS:
        return cell.isNull() | ~tests[_NEGATIONS[f.operator]]
    return F.lit(True)


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """The rows on which every filter holds."""
    held, keep = prepared(df, filters)
    return held.where(keep).select(*(column(c) for c in df.columns)) if len(held.columns) > len(df.columns) else df.where(keep)
