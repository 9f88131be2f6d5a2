from decimal import Decimal

from pyspark.sql import functions as F

from sigtrace.functions.numbers import exact_time, number, number_text


def test_number_texts(spark):
    cases = {
        " 9": "9", "009": "9", "0x09": "9", "0X9 ": "9", "9.0": "9", "9.50": "9.5", "-3": "-3", "1e3": "1000", "": None, "abc": "text:abc",
        "0xffffffffffffffff": "18446744073709551615", "0x1ffffffffffffffff": "36893488147419103231", "0x000": "0", "00": "0", "-0": "0", "+7": "7",
        "0x" + "f" * 33: "0x" + "f" * 33, "9" * 50: "9" * 50,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string")
    got = {r.s: r.n for r in df.select("s", number_text(F.col("s")).alias("n")).collect()}
    assert got == cases | {None: None}


def test_numbers_are_exact(spark):
    df = spark.createDataFrame([("0xffffffffffffffff", "1767237896.123456789"), ("x", "soon"), (None, None)], "a string, t string")
    rows = df.select(number(F.col("a")).alias("a"), exact_time(F.col("t")).alias("t")).collect()
    assert rows[0].a == Decimal(18446744073709551615) and rows[0].t == Decimal("1767237896.123456789")
    assert [tuple(r) for r in rows[1:]] == [(None, None)] * 2
