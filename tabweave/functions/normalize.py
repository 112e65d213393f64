"""Normalized texts: compatibility forms, invisible characters and odd blanks; and normalized column names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.scalars import BLANKS

# Code points that are removed, and blanks that become a plain one.
INVISIBLE = (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
ODD_BLANKS = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: Blocks most texts keep to: Latin, Greek, Cyrillic, punctuation, currencies, kana, ideographs, syllables.
_BLOCKS = ((0x0, 0x250), (0x370, 0x530), (0x2010, 0x2028), (0x20A0, 0x20C1), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))


def _class(points: Iterable[int]) -> str:
    return "[" + "".join(f"\\x{{{p:04x}}}" for p in points) + "]"


def _odd_ranges(first: int, beyond: int) -> str:
    """The characters of a block that normalizing may change, alone or with their neighbours, as ranges of a class."""
    odd = [p for p in range(first, beyond) if p in INVISIBLE or p in ODD_BLANKS or unicodedata.combining(chr(p)) or not unicodedata.is_normalized("NFKC", chr(p))]
    ranges: list[list[int]] = []
    for p in odd:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:04x}}}-\\x{{{z:04x}}}" for a, z in ranges)


def _unsettled() -> str:
    """A pattern for a character that normalizing may change: one of these blocks that isn't settled, or of none of them.

    Most characters are ASCII and leave at the first comparison; a block's own list is only looked through for its characters.
    """
    other = "".join(f"\\x{{{a:04x}}}-\\x{{{z - 1:04x}}}" for a, z in _BLOCKS)
    within = [f"[\\x{{{max(a, 128):04x}}}-\\x{{{z - 1:04x}}}&&[{odd}]]" for a, z in _BLOCKS if (odd := _odd_ranges(a, z))]
    return f"[\\x{{0080}}-\\x{{10ffff}}&&[[^{other}]{''.join(within)}]]"


_UNSETTLED = _unsettled()


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, for which Spark has no function of its own."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(c: Column) -> Column:
    """NFKC of a text; only texts with a character that may change, alone or with its neighbours, leave the JVM."""
    odd = c.rlike(_UNSETTLED)
    return F.when(odd, nfkc(F.when(odd, c))).otherwise(c)


def visible(c: Column) -> Column:
    """Composed, and without invisible characters."""
    return F.when(c.rlike(_UNSETTLED), F.regexp_replace(composed(c), _class(INVISIBLE), "")).otherwise(c)


def _cleaned(visible: Column) -> Column:
    """Blanks made plain and single, outer blanks off, of a text without invisible characters."""
    return F.btrim(F.regexp_replace(F.regexp_replace(visible, _class(ODD_BLANKS), " "), r"[ \t]+", " "), F.lit(BLANKS))


def normalized(c: Column) -> Column:
    """Composed, without invisible characters, blanks made plain and single, outer blanks off. Null gives the empty text."""
    return F.coalesce(_cleaned(visible(c)), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalization(c: Column) -> Column:
    """A struct: normalized, changed, stripped (code points removed, in order), odd_blanks (whether any blank wasn't plain).

    Whoever reads several of its fields had better hold it by `explode(array(...))`, which computes it once.
    """
    stripped = F.transform(F.regexp_extract_all(F.when(c.rlike(_UNSETTLED), c), F.lit(f"({_class(INVISIBLE)})"), F.lit(1)), lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(x)), 4, "0")))
    pair = lambda v: F.struct(F.coalesce(_cleaned(v), F.lit("")).alias("clean"), F.coalesce(v.rlike(_class(ODD_BLANKS)), F.lit(False)).alias("odd"))
    return _let(
        _let(visible(c), pair),
        lambda p: F.struct(p["clean"].alias("normalized"), (c.isNotNull() & (p["clean"] != c)).alias("changed"), F.coalesce(stripped, F.array().cast("array<string>")).alias("stripped"), p["odd"].alias("odd_blanks")),
    )


def is_settled(c: Column) -> Column:
    """A text holds nothing but characters that normalizing leaves alone, blanks aside."""
    return ~c.rlike(_UNSETTLED)


def is_changed_settled(c: Column, inner: Column) -> Column:
    """is_changed of a settled text, given what is within its outer blanks: blanks alone decide."""
    return F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t")) | (F.octet_length(inner) != F.octet_length(c))


def is_changed(c: Column) -> Column:
    """Whether normalizing changes a text; printable ASCII without blanks is left alone."""
    return F.when(c.isNotNull(), c.rlike(r"[^\x21-\x7e]") & (normalized(c) != c))


def changed_share(c: Column) -> Column:
    """The share of texts that normalizing would change."""
    return F.coalesce(F.try_divide(F.count_if(is_changed(c)), F.count(c)), F.lit(0.0))


_STEPS = ((r"([a-z])([A-Z])", r"\1_\2"), (r"([A-Z]+)([A-Z][a-z])", r"\1_\2"), (r"[\s-]+", "_"))


def column_name(name: str) -> str:
    """A name in snake case."""
    for pattern, to in _STEPS:
        name = re.sub(pattern, to, name)
    return re.sub(r"^_|_$", "", re.sub(r"_+", "_", name.lower()))


def column_name_of(c: Column) -> Column:
    """The same for names that stand in a column."""
    for pattern, to in _STEPS:
        c = F.regexp_replace(c, pattern, to.replace("\\", "$"))
    return F.regexp_replace(F.regexp_replace(F.lower(c), "_+", "_"), "^_|_$", "")


def distinct_names(names: Iterable[str | None]) -> list[str]:
    """Normalized names; blank ones are numbered by place, repeated ones by turn, past numbers that are names already."""
    used: set[str] = set()
    turns: dict[str, int] = {}
    out = []
    for i, raw in enumerate(names):
        base = name = column_name((raw or "").strip()) or f"column_{i + 1}"
        while name in used:
            turns[base] = turns.get(base, 0) + 1
            name = f"{base}_{turns[base]}"
        used.add(name)
        out.append(name)
    return out
