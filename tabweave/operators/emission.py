"""Reading texts in the way that a column's profile found: as dates, numbers or truth values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.functions.classify import DASH_DATE, DOT_DATE, SLASH_DATE
from tabweave.functions.scalars import number_of, trimmed

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: For each kind of date its pattern and the groups that hold month and day.
_DATES = {"us_date_mdy": (SLASH_DATE, 1, 2), "us_date_mdy_dash": (DASH_DATE, 1, 2), "eu_date_dmy": (DOT_DATE, 2, 1), "eu_date_dmy_slash": (SLASH_DATE, 2, 1)}


def _date(year: Column, month: Column, day: Column) -> Column:
    """Two digits of a year lie between 1970 and 2069; null for what is no day."""
    y = year.try_cast("int")
    full = F.when(F.length(year) > 2, y).otherwise(y + F.when(y < 70, 2000).otherwise(1900))
    return F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def emitted(cell: Column, kind: str, sentinels: Sequence[str] = ()) -> Column:
    """A struct of date, number and flag, of which at most one is set. Sentinels, and texts that don't fit the kind, set none."""
    s = trimmed(cell)
    none = {"date": F.lit(None).cast("date"), "number": F.lit(None).cast("double"), "flag": F.lit(None).cast("boolean")}
    if kind in _DATES:
        pattern, month, day = _DATES[kind]
        none["date"] = F.when(s.rlike(pattern), _date(F.regexp_extract(s, pattern, 3), F.regexp_extract(s, pattern, month), F.regexp_extract(s, pattern, day)))
    elif kind == "text_date_natural":
        name = F.lower(F.substring(F.regexp_extract(s, "([A-Za-z]{3,9})", 1), 1, 3))
        month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
        none["date"] = F.when(month > 0, _date(F.regexp_extract(s, r"(\d{2,4})$", 1), month.cast("string"), F.regexp_extract(s, r"(\d{1,2}),?\s", 1)))
    elif kind in ("currency_prefixed", "thousand_separated"):
        none["number"] = F.regexp_replace(s, r"(?i)[$€£¥₹,\s]|USD|EUR|GBP|JPY|CAD|AUD|CHF|INR", "").try_cast("double")
    elif kind == "percentage_string":
        none["number"] = F.when(F.endswith(s, F.lit("%")), F.regexp_replace(s, r"\s*%$", "").try_cast("double") / 100)
    elif kind == "boolean_text":
        low = F.lower(s)
        none["flag"] = F.when(low.isin("yes", "y", "true", "t"), True).when(low.isin("no", "n", "false", "f"), False)
    elif kind == "canonical":
        none["date"] = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
        none["number"] = F.when((s != "") & ~s.rlike(r"^\d{4}-\d{2}-\d{2}"), number_of(s))
    elif kind != "unknown":
        raise ValueError(f"unknown kind: {kind}")
    value = F.struct(*(c.alias(n) for n, c in none.items()))
    return F.when(~F.coalesce(s.isin(*sentinels), F.lit(False)), value) if sentinels else value
