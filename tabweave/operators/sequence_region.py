"""A region of a sequence: the first row that holds a name, its long column of bases, and a window of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.filters import column, schema_of
from tabweave.operators.order_page import ROW

BASES = r"^[ATCGNatcgn\s]+$"
LONG, LOOKED_AT, CONTEXT, END, NAMES = 100, 200, 100, 2000, 20


def sequence_region(df: DataFrame, name: str, sequence_column: str | None = None, start: int = 0, end: int = 0, context: int = 0, row: str = ROW) -> DataFrame:
    """At most one row: sequence_column, total_length, region_start, region_end, region_length, sequence, has_more, next_start, metadata.

    The name is compared with every text cell but for case. Without a column the first is taken whose text is
    long and looks like bases. A context or end of 0 means the default. No row means that there is no such name
    or no sequence. metadata maps the other columns to their texts.
    """
    names = [n for n, t in schema_of(df).items() if t.simpleString() == "string"]
    context, end = context or CONTEXT, end or END
    if not names:
        return df.sparkSession.sql("SELECT 1 AS x").where("false")
    low = name.lower()
    hit = F.exists(F.array(*(column(n) for n in names)), lambda v: F.coalesce(F.lower(v) == low, F.lit(False)))
    cells = F.struct(*(column(n) for n in df.columns))
    first = df.where(hit).agg(F.min_by(cells, column(row)).alias("r")).where("r IS NOT NULL")
    cell = lambda n: F.col(f"r.`{n}`")
    looks = lambda n: (F.char_length(cell(n)) > LONG) & F.substring(cell(n), 1, LOOKED_AT).rlike(BASES)
    candidates = [sequence_column] if sequence_column else names
    chosen = F.coalesce(*(F.when(F.lit(True) if sequence_column else looks(n), F.lit(n)) for n in candidates))
    text = F.coalesce(*(F.when(F.col("c") == n, cell(n)) for n in candidates))
    found = first.select("r", chosen.alias("c")).select("r", "c", text.alias("s")).where("c IS NOT NULL AND s <> ''")
    total = F.char_length("s")
    a, b = F.lit(max(0, start - context)), F.least(total, F.lit(end + context))
    others = F.map_filter(F.create_map(*(x for n in df.columns if n != row for x in (F.lit(n), cell(n).cast("string")))), lambda k, _: k != F.col("c"))
    return found.select(
        F.col("c").alias("sequence_column"),
        total.alias("total_length"),
        a.alias("region_start"),
        b.alias("region_end"),
        F.greatest(b - a, F.lit(0)).alias("region_length"),
        F.substring("s", a + 1, F.greatest(b - a, F.lit(0))).alias("sequence"),
        (b < total).alias("has_more"),
        (b - context).alias("next_start"),
        others.alias("metadata"),
    )


def known_names(df: DataFrame, row: str = ROW, most: int = NAMES) -> DataFrame:
    """Names to choose from: of the first rows the first column called a name or sample, else the first column."""
    named = [c for c in df.columns if "name" in c or "sample" in c]
    return df.orderBy(row).limit(most).select(column((named or df.columns)[0]).alias("name"))
