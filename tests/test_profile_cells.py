"""Profiles over cells that are counted first: against one value at a time, whatever a task holds; and quick marks against plain ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabweave.functions import classify
from tabweave.functions.scalars import trimmed
from tabweave.operators import profile
from tabweave.operators.filters import schema_of
from tests.test_integrity import VALUES

MORE = ["-123456", "-1234567", "123456.7", "12345.6", "-999", "1000", "-1000.5", "999.25", "123456\x85", "1234567\x85", "99\x85", "+1 (23) 45.67-8", "+1+2345678", "1234\xa0567", "\uff11234567", "(((((((1", "12-34-56-7", "a\xa0b@c.de", "a@b@c.de", "a@b.c", "\x01a@b.cd", "é@b.cd", "a@b.cd\x85", "0" * 9 + "-0000", "00000000-0000-4000-8000-000000000000", "$999", "€1,234.5", "5 EUR", "12.5%", "-3 %", "HTTP://X", "Aug 3, 2021", "3 Aug 2021", "N/A", "—", "13/2/2021", "2/13/2021", "1-2-21", "1.2.2021", "t", "\tx\t"]


def test_quick_marks(spark):
    rng = random.Random(1)
    texts = {v for v in VALUES + MORE if v} | {"".join(rng.choice("0123456789-+(). ,$@ab%/\xa0é:T") for _ in range(rng.randrange(1, 14))) for _ in range(4000)}
    v = F.col("v")
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "v string").select(trimmed(v).alias("v")).where("v <> ''").withColumn("kind", classify.type_of(v))
    plain = sum((F.when(c, 1 << classify.PATTERNS.index(n)).otherwise(0) for n, c in classify.patterns_of(v).items()), F.lit(0))
    odd = df.select("v", "kind", classify.quick_type_of(v).alias("quick"), plain.alias("bits"), classify.pattern_bits(v, F.col("kind")).alias("quick_bits")).where("kind <> quick OR bits <> quick_bits").collect()
    assert odd == []


@pytest.mark.parametrize("held", [1, 2000, 1 << 20])
def test_counted_cells(spark, monkeypatch, held):
    """A task gives on each distinct cell once where it can hold all, and more often else; profiles are the same."""
    monkeypatch.setattr(profile, "_HELD", held)
    monkeypatch.setattr(profile, "_COUNTED", held)
    rng = random.Random(held)
    rows = [(rng.choice(VALUES + MORE), rng.randrange(40), rng.choice([" open", "open ", "closed", "N/A", "n/a", "", None]), str(rng.randrange(10**6)), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b int, c string, d string, e string").repartition(3)
    cells = profile._counted_cells(df, df.columns, schema_of(df)).collect()
    met = Counter()
    for r in cells:
        met[r.place, None if r.cell is None else bytes(r.cell).decode()] += r.n
    assert met == Counter((i, None if x is None else str(x)) for row in rows for i, x in enumerate(row))
    assert held < 1 << 20 or len(cells) <= 3 * len(met)
    found = profile.collect_profiles(df)
    for i, name in enumerate(df.columns):
        values = [classify.strip(str(r[i])) for r in rows if r[i] is not None and classify.strip(str(r[i]))]
        p, kinds = found[name], [classify.classify_value(x) for x in values]
        assert (p.sample_size, round(p.null_rate * 3000)) == (3000, 3000 - len(values))
        assert round(p.unique_rate * len(values)) == len(set(values))
        numbers, lengths = [float(x) for x, (k, _) in zip(values, kinds, strict=True) if k in ("integer", "number")], [len(x) for x, (k, _) in zip(values, kinds, strict=True) if k not in ("integer", "number")]
        assert p.numeric_range == ((min(numbers), max(numbers)) if numbers else None) and p.length_range == ((min(lengths), max(lengths)) if lengths else None)
        assert set(p.sentinels) == {x for x in values if x.lower() in classify.SENTINELS}
        assert set(p.patterns) == {n for n in classify.PATTERNS if values and sum(n in f for _, f in kinds) >= 0.8 * len(values)}
    assert found["c"].enum_values == ("N/A", "closed", "n/a", "open") and found["b"].enum_values == () and found["c"].invisible_rate > 0
