"""Profiles and realignment: expressions against single-value functions, and injected shifts and swaps."""

import random

import pytest
from pyspark.sql import functions as F

from tabweave.functions import classify
from tabweave.operators.profile import FK_ACCEPT, FK_DIRECT, FK_FALLBACK, FK_FLOOR, FK_WIDENING, Profile, collect_profiles, foreign_key, score
from tabweave.operators.realign import check_row, fit_shares, RealignOptions, realign, score_text, summarize

VALUES = ["2024-01-02", "2024-01-02T10:00", "1/2/24", "3-Aug-2021", "a@b.co", "a@b", "$1,234.50", "12", "12.5", "-7", "yes", "T", "0", "12 %", "https://x.y/z", "+49 (30) 1234567", "words here", "1,234", "", None, "  open ", "550e8400-e29b-41d4-a716-446655440000", "99999999", "x y", "12 EUR", "  5"]
PROFILES = [
    Profile("integer", numeric_range=(0.0, 10.0)),
    Profile("number", null_rate=0.2, numeric_range=(5.0, 5.0)),
    Profile("string", enum_values=("open", "closed")),
    Profile("string", enum_values=tuple(f"v{i}" for i in range(12))),
    Profile("date", patterns=("isDate",)),
    Profile("datetime"),
    Profile("mixed", patterns=("isEmail", "isUrl")),
    Profile("boolean"),
    Profile("string", patterns=("isCurrency", "isPhone"), numeric_range=(0.0, 1.0)),
]


def test_single_values_agree_with_expressions(spark):
    from tabweave.functions.scalars import trimmed

    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    t = trimmed(F.col("v"))
    for r in df.where(t != "").select("v", classify.type_of(t).alias("type"), *(c.alias(n) for n, c in classify.patterns_of(t).items())).collect():
        kind, found = classify.classify_value(classify.strip(r.v))
        assert (r.type, {n for n in classify.PATTERNS if r[n]}) == (kind, set(found)), r
    for p in PROFILES:
        for r in df.select("v", score(F.col("v"), p).alias("s")).collect():
            assert r.s == score_text(r.v, p), (r, p)


def test_foreign_keys():
    assert FK_FLOOR <= FK_FALLBACK <= FK_WIDENING <= FK_DIRECT <= FK_ACCEPT
    assert foreign_key("person_email", Profile("string", unique_rate=0.9, patterns=("isEmail",))).target == "person.email"
    assert foreign_key("user_uid", Profile("string", unique_rate=0.1, patterns=("isUuid",))).confidence == 0.85
    assert foreign_key("notes", Profile("string", unique_rate=0.1, patterns=("isUuid",))) is None
    assert foreign_key("a_id", Profile("mixed", unique_rate=1.0)) is None
    assert foreign_key("a_code", Profile("string", unique_rate=0.01, enum_values=("x",), length_range=(1, 3))) is None
    with pytest.raises(ValueError):
        Profile(null_rate=2)


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([(None, " ")], "a string, b string")
    assert collect_profiles(df)["a"] == Profile("string", null_rate=1.0, sample_size=1)
    assert collect_profiles(df)["b"].null_rate == 1.0
    assert collect_profiles(df.where("false")) == {}


def test_realignment(spark):
    rng = random.Random(3)
    names = ["id", "status", "when", "mail", "amount"]
    good = [(str(i), rng.choice(["open", "closed"]), f"2024-01-{1 + i % 28:02d}", f"u{i}@example.org", f"${i}.50") for i in range(200)]
    profiles = collect_profiles(spark.createDataFrame(good, ", ".join(f"{n} string" for n in names)))
    moved = ("7", "", "open", "2024-01-03", "u7@example.org")
    swapped = ("8", "2024-01-04", "closed", "u8@example.org", "$8.50")
    junk = ("?", "??", "who", "knows", "what")
    df = spark.createDataFrame([(*good[0], 0), (*moved, 1), (*swapped, 2), (*junk, 3)], ", ".join(f"{n} string" for n in names) + ", k int")
    out = {r.k: r for r in realign(df, names, profiles, quarantine="mark").collect()}
    assert out[0]["__verdict"].kind == "aligned" and tuple(out[0])[:5] == good[0]
    assert out[1]["__verdict"].kind == "realigned" and tuple(out[1])[:4] == ("7", "open", "2024-01-03", "u7@example.org")
    assert out[2]["__verdict"].kind == "realigned" and tuple(out[2])[:5] == ("8", "closed", "2024-01-04", "u8@example.org", "$8.50") and out[2]["__verdict"].swaps == [["status", "when"]]
    assert out[3]["__verdict"].kind == "quarantine" and "status" in out[3]["__quarantine_reason"]
    s = summarize(realign(df, names, profiles)).first()
    assert (s.total, s.aligned, s.realigned, s.swap_only, s.quarantined) == (4, 1, 2, 1, 1)
    assert realign(df, names, profiles, quarantine="drop").count() == 3
    assert realign(df, names, {}).where("__verdict.kind = 'aligned'").count() == 4
    assert check_row([], [], [], RealignOptions())["kind"] == "aligned"
    from tabweave.operators.realign import examples

    found = examples(realign(df, names, profiles), "k", "realigned", 1).collect()
    assert [r.k for r in found] == [1] and found[0].kind == "realigned"


def test_long_numbers_are_no_phones_to_realign(spark):
    """Most ids have seven digits and read as phone numbers; rows with shorter ones and an odd amount are where they belong."""
    names = ["id", "status", "amount", "day", "mail"]
    rows = [(str(k), "open" if k % 2 else "closed", "n/a" if k % 20 == 0 else f"${k % 900}.50", "2024-01-02", f"u{k}@example.org") for k in (*range(1000, 1100), *range(1_000_000, 1_000_900))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    profiles = collect_profiles(df)
    assert profiles["id"].patterns == ("isPhone",)
    s = summarize(realign(df, names, profiles)).first()
    assert (s.total, s.aligned) == (1000, 1000)
    assert fit_shares(df, names, profiles).first().own_fit == 1
