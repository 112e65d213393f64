"""Projection, renaming by a plan, and typed values of cells."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.normalize import distinct_names
from tabweave.functions.scalars import WHOLE, number_of, text_of, trimmed
from tabweave.operators.filters import column, schema_of


def select_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in that order; names that aren't there are left out."""
    return df.select(*(column(n) for n in names if n in df.columns))


def normalize_columns(df: DataFrame) -> DataFrame:
    """All columns under normalized, distinct names."""
    return df.toDF(*distinct_names(df.columns))


@dataclass(frozen=True)
class PlanItem:
    source: str
    target: str | None = None


def resolve_columns(wanted: Sequence[str], present: Sequence[str]) -> dict[str, str]:
    """For each wanted name the present one it means: the same, the same but for case, one that holds the other
    (those that begin with it first, then the shortest), or the same but for separators. A present name is given
    once, except to a wanted name that is equal to it."""
    bare = lambda s: re.sub(r"[_\-\s]", "", s.lower())
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in wanted:
        low = name.lower()
        free = [p for p in present if p not in taken]
        near = [p for p in free if low in p.lower() or p.lower() in low]
        ranked = sorted(near, key=lambda p: (not p.lower().startswith(low), len(p)))
        choices = [name] if name in present else [p for p in free if p.lower() == low] or ranked or [p for p in free if bare(p) == bare(name)]
        if choices:
            out[name] = choices[0]
            taken.add(choices[0])
    return out


def transform_columns(df: DataFrame, plan: Sequence[PlanItem], tag: tuple[str, str] | None = None, resolve: bool = True) -> DataFrame:
    """The plan's columns under their targets; what can't be resolved is null; `tag` adds a column of one value."""
    found = resolve_columns([p.source for p in plan], df.columns) if resolve else {}
    cols: dict[str, Column] = {}
    for p in plan:
        actual = found.get(p.source, p.source)
        cols[p.target or p.source] = column(actual) if actual in df.columns else F.lit(None).cast("string")
    if tag:
        cols[tag[0]] = F.lit(tag[1])
    return df.select(*(c.alias(n) for n, c in cols.items()))


TYPED = "struct<text string, number double, flag boolean>"


def coerced(c: Column) -> Column:
    """A text cell as the value it is read as: a struct with one field set: flag (true or false in any case), number, or text.

    Blank texts stay texts; null gives null.
    """
    s = trimmed(c)
    low = F.lower(s)
    flag = F.when(low == "true", True).when(low == "false", False)
    number = F.when((s != "") & flag.isNull(), number_of(s))
    text = F.when(flag.isNull() & number.isNull(), F.when(s == "", F.lit("")).otherwise(s))
    return F.when(c.isNotNull(), F.struct(text.alias("text"), number.alias("number"), flag.alias("flag")))


def coerced_page(df: DataFrame) -> DataFrame:
    """Every column of a page as coerced values; nulls become empty texts."""
    schema = schema_of(df)
    return df.select(*(coerced(F.coalesce(text_of(column(n), kind), F.lit(""))).alias(n) for n, kind in schema.items()))


def coerced_sample(c: Column) -> Column:
    """Like coerced, for samples: blank cells are null, and a number has digits, dots and commas alone."""
    s = trimmed(c)
    low = F.lower(s)
    flag = F.when(low == "true", True).when(low == "false", False)
    number = F.when(s.rlike(r"^-?[\d.,]+$") & s.rlike(WHOLE), s.try_cast("double"))
    text = F.when(flag.isNull() & number.isNull(), s)
    return F.when(c.isNotNull() & (s != ""), F.struct(text.alias("text"), number.alias("number"), flag.alias("flag")))
