"""What kind of value a text is, as Spark expressions and for single values."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.functions.scalars import BLANK, BLANKS, trimmed

# The shapes by which values are told apart; \s stands for any blank.
_S = BLANK
DATE = r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}/\d{1,2}/\d{2,4}$|^\d{1,2}-[A-Za-z]{3,}-\d{2,4}$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CURRENCY = r"(?i)^[$€£¥]?\s?-?\d{1,3}(,\d{3})*(\.\d+)?(\s?(USD|EUR|GBP|JPY|CAD|AUD))?$"
PERCENT = r"^-?\d+(\.\d+)?\s?%$"
URL = r"(?i)^https?://[^\s]+$"
PHONE = r"^[+(]?[\d\s\-().]{7,}$"
INTEGER = r"^-?\d+$"
NUMBER = r"^-?\d+(\.\d+)?$"
BOOLEAN = r"(?i)^(true|false|yes|no|t|f|y|n|1|0)$"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
DASH_DATE = r"^(\d{1,2})-(\d{1,2})-(\d{2,4})$"
DOT_DATE = r"^(\d{1,2})\.(\d{1,2})\.(\d{2,4})$"
NATURAL_DATE = r"^(\d{1,2}\s+)?[A-Za-z]{3,9},?\s+\d{1,2},?\s+\d{2,4}$|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$"
MONEY_BEFORE = r"^[$€£¥₹]\s?-?\d{1,3}(,\d{3})*(\.\d+)?$"
MONEY_BEHIND = r"(?i)^-?\d{1,3}(,\d{3})*(\.\d+)?\s?[€£¥₹$]$|^-?\d{1,3}(,\d{3})*(\.\d+)?\s?(USD|EUR|GBP|JPY|CAD|AUD|CHF|INR)$"
THOUSANDS = r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"
YES_NO = r"(?i)^(yes|no|y|n|true|false|t|f)$"
SENTINELS = ("unknown", "n/a", "na", "tbd", "tbc", "—", "-", "?", "??", "null", "none", "pending", "unspecified", "unset", "undefined", "not applicable", "not available", "no data", "no value")
#: In the order in which a tie between types is settled.
TYPES = ("string", "number", "integer", "date", "datetime", "boolean", "mixed")
PATTERNS = ("isDate", "isDatetime", "isEmail", "isUuid", "isCurrency", "isPercent", "isUrl", "isPhone")
#: In the order in which a tie between kinds is settled.
KINDS = ("canonical", "us_date_mdy", "us_date_mdy_dash", "eu_date_dmy", "eu_date_dmy_slash", "text_date_natural", "currency_prefixed", "percentage_string", "thousand_separated", "boolean_text", "unknown")


def _java(pattern: str) -> str:
    """The pattern with \\s spelt out."""
    inside = _S[1:-1]
    return pattern.replace(r"[^\s@]", f"[^{inside}@]").replace(r"[^\s]", f"[^{inside}]").replace(r"[\d\s\-().]", rf"[\d{inside}\-().]").replace(r"\s", _S)


def _is(s: Column, pattern: str) -> Column:
    return s.rlike(_java(pattern))


def patterns_of(s: Column) -> dict[str, Column]:
    """For a trimmed text, whether it has each of the patterns. Dates have no other pattern."""
    datetime, day = _is(s, DATETIME), _is(s, DATE)
    other = ~datetime & ~day
    return {
        "isDate": ~datetime & day,
        "isDatetime": datetime,
        "isEmail": other & _is(s, EMAIL),
        "isUuid": other & _is(s, UUID),
        "isCurrency": other & _is(s, CURRENCY),
        "isPercent": other & _is(s, PERCENT),
        "isUrl": other & _is(s, URL),
        "isPhone": other & _is(s, PHONE) & (F.char_length(F.regexp_replace(s, r"\D", "")) >= 7),
    }


def type_of(s: Column) -> Column:
    """The type of a trimmed text that isn't empty."""
    return (
        F.when(_is(s, DATETIME), "datetime")
        .when(_is(s, DATE), "date")
        .when(_is(s, INTEGER), "integer")
        .when(_is(s, NUMBER), "number")
        .when(_is(s, BOOLEAN), "boolean")
        .otherwise("string")
    )


# The same for a column of trimmed texts of which there are many. A pattern is only tried where a text's first character, its
# length or a character that can't be missing leaves room for it, and once a type is known, what it rules out isn't tried.


def _first(s: Column, *codes: int) -> Column:
    """A text begins with a digit or one of these characters."""
    at = F.ascii(s)
    return at.between(48, 57) | at.isin(*codes) if codes else at.between(48, 57)


def quick_type_of(s: Column) -> Column:
    """type_of a column."""
    day, number = F.when(_is(s, DATETIME), "datetime").when(_is(s, DATE), "date"), F.when(_is(s, INTEGER), "integer").when(_is(s, NUMBER), "number")
    truth = F.when((F.octet_length(s) <= 5) & _is(s, BOOLEAN), "boolean").otherwise("string")
    return F.when(_first(s), F.coalesce(F.when(F.contains(s, F.lit("-")) | F.contains(s, F.lit("/")), day), number, truth)).when(F.ascii(s) == 45, F.coalesce(number, truth)).otherwise(truth)


def pattern_bits(s: Column, kind: Column) -> Column:
    """The patterns of a column of this type as bits, in the order of PATTERNS."""
    bit = {p: 1 << i for i, p in enumerate(PATTERNS)}
    has = lambda p, holds: F.when(holds, bit[p]).otherwise(0)
    length = F.octet_length(s)
    # a class with blanks of all kinds is slow, so printable or ASCII texts are told by one of their own before
    phone_like = s.rlike(r"^[+(]?[\t-\r 0-9().-]{7,}+\z") | ((length != F.char_length(s)) & _is(s, PHONE))
    phone = has("isPhone", (length >= 7) & _first(s, 40, 41, 43, 45, 46) & phone_like & s.rlike(r"^(?:[^0-9]*+[0-9]){7}"))
    money = has("isCurrency", _first(s, 36, 45, 163, 165, 8364) & _is(s, CURRENCY))
    others = [
        has("isEmail", F.contains(s, F.lit("@")) & (s.rlike(r"^[!-?A-~]++@[!-?A-~]+\.[!-?A-~]{2,}\z") | _is(s, EMAIL))),
        has("isUuid", (length == 36) & _is(s, UUID)),
        has("isPercent", F.endswith(s, F.lit("%")) & _first(s, 45) & _is(s, PERCENT)),
        has("isUrl", F.ascii(s).isin(72, 104) & _is(s, URL)),
    ]
    # of a plain number the places of its sign and its point say all
    plain = kind.isin("integer", "number") & F.ascii(F.right(s, F.lit(1))).between(48, 57)
    sign = F.when(F.ascii(s) == 45, 1).otherwise(0)
    whole, digits = F.when(kind == "integer", length - sign).otherwise(F.instr(s, ".") - 1 - sign), F.when(kind == "integer", length - sign).otherwise(length - 1 - sign)
    return (
        F.when(kind == "date", bit["isDate"])
        .when(kind == "datetime", bit["isDatetime"])
        .when(plain, has("isCurrency", whole <= 3) + has("isPhone", digits >= 7))
        .when(kind.isin("integer", "number"), money + phone)
        .when(kind == "string", sum(others, money + phone))
        .otherwise(0)
    )


def quick_shape_of(s: Column, kind: Column) -> Column:
    """shape_of a column of this type."""
    dated = F.when(_is(s, ISO_DAY), "canonical").when(_is(s, SLASH_DATE), "slash").otherwise("unknown")
    digit = (
        F.when(F.contains(s, F.lit("-")) & _is(s, DASH_DATE), "us_date_mdy_dash")
        .when(F.contains(s, F.lit(".")) & _is(s, DOT_DATE), "eu_date_dmy")
        .when(_is(s, NATURAL_DATE), "text_date_natural")
        .when(F.endswith(s, F.lit("%")) & _is(s, PERCENT), "percentage_string")
        .when(_is(s, MONEY_BEHIND), "currency_prefixed")
        .when(F.contains(s, F.lit(",")) & _is(s, THOUSANDS), "thousand_separated")
    )
    sign = F.when(F.ascii(s).isin(36, 163, 165, 8364, 8377) & _is(s, MONEY_BEFORE), "currency_prefixed")
    word = F.when(_is(s, NATURAL_DATE), "text_date_natural").when((F.octet_length(s) <= 5) & _is(s, YES_NO), "boolean_text")
    other = F.coalesce(F.when(_first(s, 45), digit).otherwise(F.coalesce(sign, word)), F.lit("unknown"))
    return F.when(kind.isin("datetime", "integer", "number"), "canonical").when(kind == "date", dated).when(kind == "boolean", "boolean_text").otherwise(other)


def quick_is_sentinel(s: Column) -> Column:
    """is_sentinel of a column."""
    return (F.octet_length(s) <= max(len(x.encode()) for x in SENTINELS)) & F.lower(s).isin(*SENTINELS)


def is_sentinel(s: Column) -> Column:
    return F.lower(trimmed(s)).isin(*SENTINELS)


def shape_of(s: Column) -> Column:
    """How a text would have to be read: a kind, or `slash` for dates that are either American or European."""
    return (
        F.when(_is(s, ISO_DAY) | _is(s, DATETIME) | _is(s, NUMBER), "canonical")
        .when(_is(s, SLASH_DATE), "slash")
        .when(_is(s, DASH_DATE), "us_date_mdy_dash")
        .when(_is(s, DOT_DATE), "eu_date_dmy")
        .when(_is(s, NATURAL_DATE), "text_date_natural")
        .when(_is(s, PERCENT), "percentage_string")
        .when(_is(s, MONEY_BEFORE) | _is(s, MONEY_BEHIND), "currency_prefixed")
        .when(_is(s, THOUSANDS), "thousand_separated")
        .when(_is(s, YES_NO), "boolean_text")
        .otherwise("unknown")
    )


_PYTHON_S = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern[str]:
    ignore = re.IGNORECASE if pattern.startswith("(?i)") else 0
    pattern = pattern.removeprefix("(?i)")
    pattern = pattern.replace(r"[^\s@]", f"[^{_PYTHON_S}@]").replace(r"[^\s]", f"[^{_PYTHON_S}]").replace(r"[\d\s\-().]", rf"[\d{_PYTHON_S}\-().]").replace(r"\s", f"[{_PYTHON_S}]")
    return re.compile(re.sub(r"\$(?=$|\|)", r"\\Z", pattern), re.ASCII | ignore)


def strip(text: str) -> str:
    return text.strip(BLANKS)


def classify_value(text: str) -> tuple[str, frozenset[str]]:
    """Type and patterns of one trimmed text."""
    has = lambda p: bool(_compiled(p).match(text))
    if has(DATETIME):
        return "datetime", frozenset({"isDatetime"})
    if has(DATE):
        return "date", frozenset({"isDate"})
    found = {n for n, p in (("isEmail", EMAIL), ("isUuid", UUID), ("isUrl", URL), ("isCurrency", CURRENCY), ("isPercent", PERCENT)) if has(p)}
    if has(PHONE) and sum(c in "0123456789" for c in text) >= 7:
        found.add("isPhone")
    for kind, pattern in (("integer", INTEGER), ("number", NUMBER), ("boolean", BOOLEAN)):
        if has(pattern):
            return kind, frozenset(found)
    return "string", frozenset(found)
