from pyspark.sql import functions as F

import pytest

from tabweave.operators.emission import emitted

CASES = {
    "us_date_mdy": [("2/30/2021", None), ("2/3/21", "2021-02-03"), ("x", None), (None, None)],
    "eu_date_dmy_slash": [("13/2/1999", "1999-02-13"), ("1/13/2020", None)],
    "us_date_mdy_dash": [("12-31-71", "1971-12-31")],
    "eu_date_dmy": [("1.2.2020", "2020-02-01")],
    "text_date_natural": [("Aug 4, 2025", "2025-08-04"), ("4 August 2025", "2025-08-04"), ("Foo 4, 2025", None)],
    "currency_prefixed": [("$1,234.50", "1234.5"), ("12 EUR", "12.0"), ("€ -3", "-3.0"), ("n/a", None)],
    "percentage_string": [("12.5 %", "0.125"), ("12", None)],
    "thousand_separated": [("1,234,567", "1234567.0")],
    "boolean_text": [("Yes", "true"), (" f ", "false"), ("maybe", None)],
    "canonical": [("2024-01-02", "2024-01-02"), ("12", "12.0"), ("", None)],
    "unknown": [("anything", None)],
}


@pytest.mark.parametrize("kind", CASES)
def test_emission(spark, kind):
    df = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(CASES[kind])], "t string, i int")
    e = emitted(F.col("t"), kind, ("n/a",))
    text = F.coalesce(e["date"].cast("string"), e["number"].cast("string"), e["flag"].cast("string"))
    assert [r[0] for r in df.orderBy("i").select(text).collect()] == [w for _, w in CASES[kind]]


def test_unknown_kind():
    with pytest.raises(ValueError):
        emitted(F.lit("x"), "roman_numerals")
