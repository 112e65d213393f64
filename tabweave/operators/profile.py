"""Profiles of columns: types, patterns, ranges, enumerations, and how values would have to be read.

Cells are read once. A task counts equal cells of a column first, as long as the distinct ones fit into its memory, so that
each is looked at once. Then it tells a cell's marks (type, patterns, shape) and counts how often a column has which
combination of them; what leaves a task are these few rows. Distinct values are counted by 64-bit hashes. No cell's text is
dealt out but those of a task's columns with few distinct values, and sentinels. Only columns with characters that the JVM
can't compose are read once more, for those cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabweave.functions.classify import KINDS, PATTERNS, TYPES, is_sentinel, pattern_bits, patterns_of, quick_is_sentinel, quick_shape_of, quick_type_of, strip, type_of
from tabweave.functions.normalize import is_changed, is_changed_settled, is_settled
from tabweave.functions.scalars import quick_trimmed, text_of, trimmed
from tabweave.operators.filters import column, schema_of
from tabweave.session import scratch

MOST_ENUM, ENUM_SHARE, COVERAGE = 30, 0.5, 0.8
#: Floor of detection, then where a key is confirmed elsewhere, where cubes widen, where it is used and accepted; ascending.
FK_FLOOR, FK_FALLBACK, FK_WIDENING, FK_DIRECT, FK_ACCEPT = 0.60, 0.60, 0.70, 0.75, 0.75


@dataclass(frozen=True)
class Profile:
    """A column's profile; ranges and enumerations are empty where they don't apply."""

    primary_type: str = "string"
    null_rate: float = 0.0
    unique_rate: float = 0.0
    sample_size: int = 0
    enum_values: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    numeric_range: tuple[float, float] | None = None
    length_range: tuple[int, int] | None = None
    invisible_rate: float = 0.0
    emission: str = "canonical"
    emission_confidence: float = 1.0
    sentinels: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for name in ("null_rate", "unique_rate", "invisible_rate", "emission_confidence"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} isn't a share: {getattr(self, name)}")
        if self.primary_type not in TYPES or self.emission not in KINDS or set(self.patterns) - set(PATTERNS) or self.sample_size < 0:
            raise ValueError(f"not a profile: {self}")


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, cell) for every cell, as texts."""
    schema = schema_of(df)
    names = [c for c in (columns or df.columns) if c in schema]
    return df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), text_of(column(n), schema[n]).alias("cell")) for n in names))).alias("c")).select("c.*")


#: Bytes of cells that a task holds before it counts equal ones, and of distinct ones before it gives them on.
_HELD, _COUNTED = 16 << 20, 32 << 20
#: Instead of a code of marks: a row of a hash, of a text.
_HASH, _TEXT = -1, -2
_SHAPES = (*KINDS, "slash")


def _place_in(c: Column, names: Sequence[str]) -> Column:
    """From 1; 0 for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)).cast("int")


def _is_few(values: pa.Array) -> bool:
    """Whether these are at most MOST_ENUM values that aren't blank, outer blanks aside."""
    found: set[str] = set()
    for at in range(0, len(values), 1000):
        found.update(strip(v.decode("utf-8", "surrogateescape")) for v in values[at : at + 1000].to_pylist() if v)
        if len(found - {""}) > MOST_ENUM:
            return False
    return True


def _counted_cells(df: DataFrame, names: Sequence[str], schema: Mapping[str, object]) -> DataFrame:
    """(place, cell, n, few): each column's cells by its place among these names, as bytes, with how often a task has met them.

    Equal cells are joined within a task as far as their distinct ones fit into _COUNTED bytes; what is more is given on before,
    and may come again. few: those given on together with this cell are so few that the column may be an enumeration.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[list[pa.Table]] = [[] for _ in names]
        held: list[pa.RecordBatch] = []

        def count() -> None:
            for i, found in enumerate(counts):
                one = pc.value_counts(pa.chunked_array([b.column(i) for b in held], pa.binary()))
                found.append(pa.table({"cell": one.field("values"), "n": one.field("counts")}))
            held.clear()

        def join() -> None:
            for found in counts:
                if len(found) > 1:
                    found[:] = [pa.concat_tables(found).group_by("cell", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]

        def give(i: int) -> Iterator[pa.RecordBatch]:
            for table in counts[i]:
                cells = table.column("cell").combine_chunks()
                cells = cells if isinstance(cells, pa.Array) else cells.chunk(0)
                few = _is_few(cells)
                for b in table.combine_chunks().to_batches(max_chunksize=50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), b.column("cell"), b.column("n"), pa.array(np.full(len(b), few))], names=["place", "cell", "n", "few"])
            counts[i] = []

        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < _HELD:
                continue
            count()
            size = 0
            if sum(t.nbytes for found in counts for t in found) > _COUNTED:
                join()
                sizes = [sum(t.nbytes for t in found) for found in counts]
                for i in sorted(range(len(names)), key=lambda i: -sizes[i]):
                    if sum(sizes) <= _COUNTED // 2:
                        break
                    yield from give(i)
                    sizes[i] = 0
        if held:
            count()
        join()
        for i in range(len(names)):
            yield from give(i)

    texts = df.select(*(text_of(column(n), schema[n]).cast("binary").alias(f"c{i}") for i, n in enumerate(names)))
    return texts.mapInArrow(run, "place int, cell binary, n long, few boolean")


def _apart(df: DataFrame) -> DataFrame:
    """df as it is, in a step of its own: what it computes isn't computed anew by the next, and the code of both is compiled
    apart, as the marks of a cell are more than the JVM compiles as one method."""
    return df.coalesce(1 << 20)


def _sum(value: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, value)), F.lit(0))


def profiles(df: DataFrame, columns: Sequence[str] | None = None, share: float = 1.0) -> DataFrame:
    """One row for each column, with the fields of Profile; a column without values is a string of null rate 1.

    df is read once, and columns with characters that only Python's tables can compose once more.

    The rows are as many as the columns; the values of an enumeration are at most MOST_ENUM. With a share below 1 only so
    many rows are looked at, those of small hashes, and sample_size says how many they were.
    """
    if share < 1:
        df = df.where(F.pmod(F.xxhash64(*(column(c) for c in df.columns)), F.lit(1_000_000)) < share * 1_000_000)
    schema = schema_of(df)
    names = [c for c in (columns or df.columns) if c in schema]
    # outer blanks don't make a value another one, but they do count as invisible
    v, cell = F.col("value"), F.col("cell")
    counted = _counted_cells(df, names, schema)
    raw = _apart(counted.select("place", cell.cast("string").alias("cell"), "n", "few").withColumn("value", quick_trimmed(cell)))
    raw = raw.select("place", "value", "n", "few", (v.isNotNull() & (v != "")).alias("there"), (cell.isNotNull() & ~is_settled(cell)).alias("unsettled"), F.coalesce(is_changed_settled(cell, v), F.lit(False)).alias("spaced"))
    t, kind = F.col("there"), F.col("kind")
    typed = raw.withColumns({"kind": F.when(t, quick_type_of(v)), "real": t & ~quick_is_sentinel(v)})
    typed = _apart(typed.select("place", "value", "n", "few", "there", "kind", "real", "unsettled", (F.col("spaced") & ~F.col("unsettled")).alias("odd")))
    typed = _apart(typed.withColumn("shape", F.when(F.col("real"), quick_shape_of(v, kind))))
    typed = _apart(typed.withColumn("bits", F.when(t, pattern_bits(v, kind))))
    numeric = t & kind.isin("integer", "number")
    european = F.col("real") & (kind == "date") & F.contains(v, F.lit("/")) & (F.split_part(v, F.lit("/"), F.lit(1)).try_cast("int") > 12)
    flags = [t, F.col("unsettled"), F.col("odd"), F.coalesce(european, F.lit(False))]
    parts = [F.coalesce("bits", F.lit(0)), _place_in(kind, TYPES) * 256, _place_in(F.col("shape"), _SHAPES) * 4096, *(F.when(f, 65536 << i).otherwise(0) for i, f in enumerate(flags))]
    size = F.when(numeric, v.try_cast("double")).when(t, F.char_length(v).cast("double"))
    typed = _apart(typed.select("place", "value", "n", (t & (F.col("few") | ~F.col("real"))).alias("kept"), "there", sum(parts[1:], parts[0]).cast("int").alias("code"), size.alias("size"), F.xxhash64("value").alias("hash")))
    # a row for a cell's marks, one for its text as a 64-bit hash, which is all that is dealt out of most, and one for a text that may be listed
    row = lambda code, hash=F.lit(None).cast("long"), text=F.lit(None).cast("string"), n=F.lit(0).cast("long"), size=F.lit(None).cast("double"): F.struct(code.alias("code"), hash.alias("hash"), text.alias("text"), n.alias("n"), size.alias("size"))
    rows = F.array(row(F.col("code"), n=F.col("n"), size=F.col("size")), F.when(t, row(F.lit(_HASH), hash=F.col("hash"))), F.when(F.col("kept"), row(F.lit(_TEXT), text=v)))
    told = typed.select("place", F.explode(rows).alias("r")).where("r IS NOT NULL").select("place", "r.*").groupBy("place", "code", "hash", "text").agg(F.sum("n").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    told = _written(told.groupBy("place", "code", "text").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    distinct = told.where(F.col("code") == _HASH).select("place", "distinct")
    code, n = F.col("code"), F.col("n")
    of = lambda by, names: F.get(F.array(*map(F.lit, names)), F.shiftright(code, by).bitwiseAND(15) - 1)
    marks = told.where(code >= 0).select("place", "n", "low", "high", of(8, TYPES).alias("kind"), of(12, _SHAPES).alias("shape"), *((code.bitwiseAND(65536 << i) != 0).alias(f) for i, f in enumerate(("there", "unsettled", "odd", "european"))), code.alias("bits"))
    has = lambda p: F.col("bits").bitwiseAND(1 << PATTERNS.index(p)) != 0
    sums = marks.groupBy("place").agg(
        F.sum("n").alias("sample_size"),
        _sum(n, t).alias("filled"),
        *(_sum(n, t & (F.col("kind") == k)).alias(f"t_{k}") for k in TYPES),
        *(_sum(n, t & has(p)).alias(f"p_{p}") for p in PATTERNS),
        *(_sum(n, F.col("shape") == k).alias(f"s_{k}") for k in _SHAPES),
        F.coalesce(F.bool_or("european"), F.lit(False)).alias("european"),
        F.min(F.when(numeric, F.col("low"))).alias("num_min"),
        F.max(F.when(numeric, F.col("high"))).alias("num_max"),
        F.min(F.when(t & ~numeric, F.col("low"))).cast("int").alias("len_min"),
        F.max(F.when(t & ~numeric, F.col("high"))).cast("int").alias("len_max"),
        _sum(n, t & F.col("odd")).alias("odd"),
        _sum(n, t & F.col("shape").isNull()).alias("n_sentinels"),
        _sum(n, t & F.col("unsettled")).alias("n_unsettled"),
    )
    name = F.get(F.array(*map(F.lit, names)), F.col("place"))
    sums = _written(sums.join(distinct, "place", "left").withColumns({"distinct": F.coalesce("distinct", F.lit(0)), "column": name}).drop("place"))
    seen = sums.select("column", "n_sentinels", "n_unsettled").collect()  # a row for each column
    # characters that only Python's tables can compose are looked at where there are any
    unsettled = [r["column"] for r in seen if r.n_unsettled]
    if unsettled:
        more = cells(df, unsettled).where(cell.isNotNull() & ~is_settled(cell) & (trimmed(cell) != "")).groupBy("column").agg(F.count_if(is_changed(cell)).alias("more"))
        sums = sums.join(_written(more), "column", "left").withColumn("odd", F.col("odd") + F.coalesce("more", F.lit(0)))
    filled = F.col("filled")
    share = lambda c: F.try_divide(c, filled)
    # types by count, ties in the order of TYPES
    ranked = F.array_sort(F.array(*(F.struct((-F.col(f"t_{k}")).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(TYPES))))
    top, second = F.get(F.col("ranked"), F.lit(0)), F.get(F.col("ranked"), F.lit(1))
    pair = F.array_sort(F.array(top["kind"], second["kind"]))
    siblings = (pair == F.array(F.lit("integer"), F.lit("number"))) | (pair == F.array(F.lit("date"), F.lit("datetime")))
    primary = (
        F.when(filled == 0, "string")
        .when((second["minus"] < 0) & (share(-second["minus"]) > 0.2) & (share(-top["minus"]) < 0.8) & ~siblings, "mixed")
        .when((F.col("t_date") > 0) & (F.col("t_datetime") > 0), "datetime")
        .when((F.col("t_integer") > 0) & (F.col("t_number") > 0), "number")
        .otherwise(top["kind"])
    )
    slash = F.col("s_slash")
    shapes = {k: F.col(f"s_{k}") for k in KINDS}
    shapes["us_date_mdy"] = F.when(F.col("european"), F.lit(0)).otherwise(slash)
    shapes["eu_date_dmy_slash"] = F.when(F.col("european"), slash).otherwise(F.lit(0))
    best = F.get(F.array_sort(F.array(*(F.struct((-c).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, (k, c) in enumerate(shapes.items())))), F.lit(0))
    real_total = sum(shapes.values(), F.lit(0))
    covered = F.try_divide(-F.col("best.minus"), F.col("real"))
    out = sums.withColumn("ranked", ranked).withColumn("best", best).withColumn("real", real_total)
    out = out.select(
        "column",
        primary.alias("primary_type"),
        ((F.col("sample_size") - filled) / F.col("sample_size")).alias("null_rate"),
        F.coalesce(share(F.col("distinct")), F.lit(0.0)).alias("unique_rate"),
        "sample_size",
        "distinct",
        F.array_compact(F.array(*(F.when(share(F.col(f"p_{p}")) >= COVERAGE, F.lit(p)) for p in PATTERNS))).alias("patterns"),
        "num_min",
        "num_max",
        "len_min",
        "len_max",
        F.coalesce(share(F.col("odd")), F.lit(0.0)).alias("invisible_rate"),
        F.when(F.col("real") == 0, "canonical").when(covered >= COVERAGE, F.col("best.kind")).otherwise("unknown").alias("emission"),
        F.coalesce(covered, F.lit(1.0)).alias("emission_confidence"),
    )
    few = [r["column"] for r in out.where((F.col("distinct") > 0) & (F.col("distinct") <= MOST_ENUM) & (F.col("unique_rate") <= ENUM_SHARE) & ~F.col("primary_type").isin("mixed", "date", "datetime")).select("column").collect()]
    apart = [r["column"] for r in seen if r.n_sentinels]
    none = F.array().cast("array<string>")
    if few or apart:
        # MOST_ENUM values for a column, and the ways to write a sentinel
        value, named = F.col("value"), F.col("column").isin(*few) if few else F.lit(False)
        kept = told.where(code == _TEXT).select(name.alias("column"), F.col("text").alias("value")).select("column", "value", is_sentinel(value).alias("apart"), named.alias("few")).where("few OR apart")
        listed = kept.groupBy("column").agg(F.array_sort(F.collect_list(F.when(F.col("few"), F.col("value")))).alias("enum_values"), F.array_sort(F.collect_list(F.when(F.col("apart"), F.col("value")))).alias("sentinels"))
        out = out.join(_written(listed), "column", "left")
    else:
        out = out.withColumns({"enum_values": none, "sentinels": none})
    return out.withColumns({c: F.coalesce(c, none) for c in ("enum_values", "sentinels")}).drop("distinct")


def _written(values: DataFrame) -> DataFrame:
    """Counts of values in the shared folder, so that cells are read once for all that is asked of them."""
    spark = values.sparkSession
    path = f"{scratch(spark, 'profile')}/t"
    values.write.parquet(path)
    return spark.read.schema(values.schema).parquet(path)


def profile_of(row: Row) -> Profile:
    """A row of profiles() as a Profile."""
    return Profile(
        row.primary_type, row.null_rate, row.unique_rate, row.sample_size, tuple(row.enum_values), tuple(row.patterns),
        None if row.num_min is None else (row.num_min, row.num_max), None if row.len_min is None else (row.len_min, row.len_max),
        row.invisible_rate, row.emission, row.emission_confidence, tuple(row.sentinels),
    )


def collect_profiles(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Profile]:
    """Profiles by column; the driver gets one row for each column."""
    return {r["column"]: profile_of(r) for r in profiles(df, columns).collect()}


def score(cell: Column, p: Profile) -> Column:
    """How well a text cell fits a profile, from 0 to 1, as one expression of literals."""
    return score_trimmed(trimmed(cell), p)


def score_trimmed(v: Column, p: Profile) -> Column:
    """The same for a cell without outer blanks."""
    kind = type_of(v)
    related = {"number": ("number", "integer"), "integer": ("integer", "number"), "date": ("date", "datetime"), "datetime": ("datetime", "date")}
    fits = F.lit(True) if p.primary_type == "mixed" else kind.isin(*related.get(p.primary_type, (p.primary_type,)))
    # each step bounds the one before from below and above, so that none is written out twice
    out = F.when(fits, 0.7).otherwise(0.5 if p.primary_type == "string" else 0.1)
    if p.enum_values:
        inside = v.isin(*p.enum_values)
        out = F.least(F.greatest(out, F.when(inside, 0.95).otherwise(0.0)), F.when(inside, 1.0).otherwise(0.1 if len(p.enum_values) <= 10 else 0.3))
    if p.patterns:
        has = patterns_of(v)
        share = sum((has[x].cast("int") for x in p.patterns), F.lit(0)) / len(p.patterns)
        out = F.least(F.greatest(out, F.when(share >= 0.8, 0.9).otherwise(0.0)), F.when(share == 0, 0.2).otherwise(1.0))
    if p.numeric_range:
        low, high = p.numeric_range
        span = (high - low) or abs(high) or 1.0
        number = F.when(kind.isin("integer", "number"), v.try_cast("double"))
        out = F.least(out, F.when((number < low - span * 100) | (number > high + span * 100), 0.4).otherwise(1.0))
    return F.when(v.isNull() | (v == ""), 0.7 if p.null_rate >= 0.05 else 0.3).otherwise(out)


def fit(df: DataFrame, name: str, p: Profile) -> DataFrame:
    """One row: how well a column's cells fit a profile on average; 0.5 without cells."""
    kind = schema_of(df)[name]
    return df.agg(F.coalesce(F.avg(score(text_of(column(name), kind), p)), F.lit(0.5)).alias("fit"))


_SUFFIX = re.compile(r"^(.+)_(id|uid|fk|key|ref|code|email)$", re.IGNORECASE)


@dataclass(frozen=True)
class ForeignKey:
    confidence: float
    signal: str
    target: str | None
    reasons: tuple[str, ...]


def foreign_key(name: str, p: Profile) -> ForeignKey | None:
    """Whether a column looks like a reference to another table's key: by its name's ending, its values' shape and how rarely they repeat."""
    named = _SUFFIX.match(name.strip())
    longest = p.length_range[1] if p.length_range else 0
    codes = p.primary_type == "string" and not {"isDate", "isDatetime", "isUrl"} & set(p.patterns) and 0 < longest <= 64
    shape = next((s for s, holds in (("uuid_shape", "isUuid" in p.patterns), ("email_shape", "isEmail" in p.patterns), ("integer_id_shape", p.primary_type == "integer"), ("short_code_shape", codes)) if holds), None)
    unique = p.unique_rate >= 0.7
    text_like = longest > 64 and not unique
    status_like = bool(p.enum_values) and p.unique_rate < 0.1
    if not name or p.primary_type == "mixed" or text_like or status_like:
        return None
    levels = {(True, True, True): 0.95, (True, True, False): 0.85, (True, False, True): 0.75, (True, False, False): 0.65, (False, True, True): 0.60}
    confidence = levels.get((bool(named), shape is not None, unique), 0.0)
    if confidence < FK_FLOOR:
        return None
    target = None
    if named:
        suffix = named[2].lower()
        target = f"{named[1].lower()}.{'id' if suffix == 'uid' else suffix}"
    reasons = [f"name ends in _{named[2].lower()}"] if named else ["no telling name"]
    reasons += [shape or "no clear shape", f"unique rate {p.unique_rate:.2f}"]
    return ForeignKey(confidence, shape if shape and (not named or confidence >= 0.85) else "name_suffix_only", target, tuple(reasons))
