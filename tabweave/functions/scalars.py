"""Scalar rules of loosely typed cells, as Spark expressions.

Cells are strings, numbers, booleans or nulls, and the rules are those of a language in
which any of them can be read as a text or a number: `text_of` and `number_of` read whole
cells, `leading_number` reads as much of a number as stands at a cell's beginning.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The blanks of that language, as a character class that Java's and RE2's patterns share.
BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
DECIMAL = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
LEADING = rf"^{BLANK}*([+-]?(?:Infinity|{DECIMAL}))"
WHOLE = rf"^[+-]?(?:Infinity|{DECIMAL})$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"
#: Prefixes of numbers in other bases: the base, its digits, and how many of them a double surely holds; twice as many are read.
BASES = {"0x": (16, "0-9a-fA-F", 13), "0o": (8, "0-7", 17), "0b": (2, "01", 52)}


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def quick_trimmed(c: Column) -> Column:
    """trimmed of a column; all but texts that begin or end with another blank than a space are done by the plain trim."""
    return F.when(F.trim(c).rlike(r"^[^!-~]|[^!-~]\z"), F.btrim(c, F.lit(BLANKS))).otherwise(F.trim(c))


def _kind(kind: T.DataType | None) -> T.DataType:
    return kind or T.StringType()


def text_of(c: Column, kind: T.DataType | None = None) -> Column:
    """The text of a cell; null stays null. Whole doubles have no fraction, exponents begin at 1e21 and below 1e-6.

    A double has as few digits as tell it from its neighbours (but for a few below 1e-300, which get one more).
    """
    kind = _kind(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain, size = c.cast("string"), F.abs(c)
        # Java's own text may have a digit too many
        short = F.upper(F.format_string("%.15e", c.cast("double")))
        sign = F.when(c < 0, "-").otherwise("")
        return (
            F.when(F.isnan(c), "NaN")
            .when(size == math.inf, F.when(c > 0, "Infinity").otherwise("-Infinity"))
            .when((c == F.floor(c)) & (size < 1e15), c.cast("long").cast("string"))
            .when((F.length(plain) > 17) & (short.cast("double") == c), F.concat(sign, _shifted(short, size)))
            .when(~F.contains(plain, F.lit("E")), plain)
            .when(c.isNotNull(), F.concat(sign, _shifted(plain, size)))
        )
    return c.cast("string")


def _shifted(plain: Column, size: Column) -> Column:
    """The digits of a text like `1.25E-5` with the point where its exponent says, or with an exponent of the other form."""
    one, more = F.regexp_extract(plain, r"(\d)\.", 1), F.nullif(F.rtrim(F.regexp_extract(plain, r"\.(\d+)E", 1), F.lit("0")), F.lit(""))
    digits = F.concat(one, F.coalesce(more, F.lit("")))
    e, n = F.regexp_extract(plain, r"E([+-]?\d+)$", 1).try_cast("int"), F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    large = F.when(n <= e + 1, F.concat(digits, zeros(e + 1 - n))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    small = F.concat(F.lit("0."), zeros(-e - 1), digits)
    exponent = F.concat(one, F.coalesce(F.concat(F.lit("."), more), F.lit("")), F.when(e < 0, "e").otherwise("e+"), e.cast("string"))
    return F.when((size < 1e21) & (size >= 1), large).when((size < 1) & (size >= 1e-6), small).otherwise(exponent)


def number_of(c: Column, kind: T.DataType | None = None) -> Column:
    """The number that a whole cell is read as; null for what is none. Nulls and blank texts are zero, true is one.

    Hexadecimal, octal and binary numbers are read up to 26, 34 and 104 digits; longer ones are none.
    """
    kind = _kind(kind)
    if isinstance(kind, T.StringType):
        s = trimmed(c)
        prefix, digits = F.lower(F.substring(s, 1, 2)), F.substring(s, 3, 400)
        based = F.lit(None).cast("double")
        for begin, (base, kinds, half) in BASES.items():
            based = F.when((prefix == begin) & digits.rlike(f"^[{kinds}]{{1,{2 * half}}}$"), _based(digits, base, half)).otherwise(based)
        return F.when(c.isNull() | (s == ""), F.lit(0.0)).when(s.rlike(WHOLE), s.try_cast("double")).otherwise(based)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("int").cast("double"), F.lit(0.0))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    return c.cast("string").try_cast("double")


def _based(digits: Column, base: int, half: int) -> Column:
    """The number of up to 2 * half digits of a base; either half is a whole double, so their sum is rounded once."""
    part = lambda x: F.coalesce(F.conv(F.nullif(x, F.lit("")), base, 10).try_cast("double"), F.lit(0.0))
    n = F.length(digits)
    return part(F.substr(digits, F.lit(1), F.greatest(n - half, F.lit(0)))) * float(base**half) + part(F.substr(digits, F.greatest(n - half, F.lit(0)) + 1))


def leading_number(c: Column, kind: T.DataType | None = None) -> Column:
    """The number at a cell's beginning (`12abc` is 12, `1,234` is 1); null if there is none."""
    if isinstance(_kind(kind), T.NumericType):
        return c.cast("double")
    return F.nullif(F.regexp_extract(c.cast("string"), LEADING, 1), F.lit("")).try_cast("double")


def is_iso_date(c: Column) -> Column:
    return c.rlike(ISO_DATE)


def instant_of(c: Column) -> Column:
    """Seconds since 1970 (UTC unless the text has a zone) of a text that begins with a date; null if it is no instant."""
    return F.when(is_iso_date(c), F.unix_micros(F.try_to_timestamp(c)) / 1e6)


def is_blank(c: Column, kind: T.DataType | None = None) -> Column:
    """Null or the empty text."""
    return c.isNull() | (c == "") if isinstance(_kind(kind), T.StringType) else c.isNull()


def dirty_cast(c: Column) -> Column:
    """A cell whose leading number differs from its plain cast: it would change its value under a strict cast."""
    strict = F.when(trimmed(c).rlike(WHOLE), trimmed(c).try_cast("double"))
    return ~F.coalesce(leading_number(c), F.lit(math.nan)).eqNullSafe(F.coalesce(strict, F.lit(math.nan)))


def text_of_value(v: object) -> str:
    """The text of a value given with a request."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if v == int(v) and abs(v) < 1e21:
            return str(int(v))
        text = repr(v)
        if "e" not in text:
            return text
        return format(Decimal(text), "f") if 1e-6 <= abs(v) < 1 else text.replace("e-0", "e-")
    return str(v)


def number_of_value(v: object) -> float | None:
    """The number that a value given with a request is read as; None for what is none."""
    import re

    if v is None:
        return 0.0
    if isinstance(v, (bool, int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    s = str(v).strip()
    if not s:
        return 0.0
    if re.fullmatch(WHOLE.strip("^$"), s):
        return float(s.replace("Infinity", "inf"))
    base, kinds, half = BASES.get(s[:2].lower(), (10, "", 0))
    return float(int(s[2:], base)) if kinds and re.fullmatch(f"[{kinds}]{{1,{2 * half}}}", s[2:]) else None
