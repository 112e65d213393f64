import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.normalize import column_name, distinct_names, normalization
from tabweave.functions.scalars import dirty_cast, instant_of, leading_number, number_of, number_of_value, text_of, text_of_value
from tabweave.operators.project import coerced, resolve_columns


def test_numbers(spark):
    cases = {
        "12abc": (None, 12.0), "1,234": (None, 1.0), "0x10": (16.0, 0.0), " 42 ": (42.0, 42.0), "": (0.0, None), None: (0.0, None), "1e3": (1000.0, 1000.0), ".5": (0.5, 0.5), "-.5x": (None, -0.5),
        "1d": (None, 1.0), "NaN": (None, None), "Infinity": (math.inf, math.inf), "007": (7.0, 7.0), "1.": (1.0, 1.0), " 7 ": (7.0, 7.0), "true": (None, None), "0b11": (3.0, 0.0), "0X" + "f" * 26: (float(16**26), 0.0), "0x" + "f" * 27: (None, 0.0), "0xFFFFFFFFFFFFFFF1": (float(0xFFFFFFFFFFFFFFF1), 0.0), "0o" + "7" * 20: (float(8**20 - 1), 0.0), "0o8": (None, 0.0), "+5": (5.0, 5.0), "1e": (None, 1.0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    for r in df.select("c", number_of(F.col("c")).alias("n"), leading_number(F.col("c")).alias("p"), dirty_cast(F.col("c")).alias("d")).collect():
        assert (r.n, r.p) == cases[r.c], r
    for text, (whole, _) in cases.items():
        assert number_of_value(text) == whole, text


def test_texts_of_doubles(spark):
    cases = {1.0: "1", -0.5: "-0.5", 1e21: "1e+21", 123456789.25: "123456789.25", 1e-7: "1e-7", 0.001: "0.001", 0.0001: "0.0001", 1e20: "100000000000000000000", math.inf: "Infinity", 1 / 30: "0.03333333333333333", 0.1 + 0.2: "0.30000000000000004", -1.5e-6: "-0.0000015", 1.25e20: "125000000000000000000", -1.25e25: "-1.25e+25", 2.0**-44: "5.684341886080802e-14", 2e23: "2e+23", 9007199254740993.5e-20: "0.00009007199254740993", 123456.789e10: "1234567890000000", 12345678.9: "12345678.9", -0.0: "0"}
    df = spark.createDataFrame([(k,) for k in cases], "c double")
    for r in df.select("c", text_of(F.col("c"), T.DoubleType()).alias("t")).collect():
        assert r.t == cases[r.c], r
    assert [text_of_value(v) for v in (None, True, 2.0, 2.5, "x", 3)] == ["null", "true", "2", "2.5", "x", "3"]


def test_instants(spark):
    df = spark.createDataFrame([("1970-01-02",), ("1970-01-01T00:00:01Z",), ("1970-13-01",), ("soon",), (None,)], "c string")
    assert [r[0] for r in df.select(instant_of(F.col("c"))).collect()] == [86400.0, 1.0, None, None, None]


def test_names():
    wanted = {"Percent_Q30": "percent_q30", "OD_450nm": "od_450nm", "sampleTypeID": "sample_type_id", "firstName": "first_name", "HTMLParser": "html_parser", "Sample Name": "sample_name", "first-name": "first_name", "_leading": "leading", "trailing_": "trailing"}
    assert {k: column_name(k) for k in wanted} == wanted
    assert distinct_names(["a", "A", "", None, "a"]) == ["a", "a_1", "column_3", "column_4", "a_2"]


def test_resolving_columns():
    assert resolve_columns(["created", "ID", "userName", "zip", "x"], ["created_at", "id", "user-name", "zip_code_long", "zip_code"]) == {"created": "created_at", "ID": "id", "userName": "user-name", "zip": "zip_code"}
    assert resolve_columns(["a", "A"], ["a"]) == {"a": "a"}


def test_coercion(spark):
    df = spark.createDataFrame([(x,) for x in ("", None, " TRUE", "12", "1,2", "x ")], "c string")
    got = [r.c and tuple(r.c) for r in df.select(coerced(F.col("c")).alias("c")).collect()]
    assert got == [("", None, None), None, (None, None, True), (None, 12.0, None), ("1,2", None, None), ("x", None, None)]


def test_normalization(spark):
    df = spark.createDataFrame([("plain",), ("a​b  c",), ("ﬁn ",), ("Ａ",), (None,), ("",)], "c string")
    got = [tuple(r.n) for r in df.select(normalization(F.col("c")).alias("n")).collect()]
    assert got == [("plain", False, [], False), ("ab c", True, ["U+200B"], False), ("fin", True, [], False), ("A", True, [], False), ("", False, [], False), ("", False, [], False)]
