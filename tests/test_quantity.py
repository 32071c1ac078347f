from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sealbook.functions.quantity import (
    format_micros,
    micros_from_binary_double,
    micros_from_number,
    micros_from_text,
    pretty_micros,
)

TEXTS = {
    "12": 12_000_000, "3.25": 3_250_000, "0.000009": 9, "-8.125": -8_125_000, "70000": 7 * 10**10, "00.50": 500_000,
    "4.0000005": 4_000_001, "4.0000004": 4_000_000, "-4.0000005": -4_000_001, "+6": 6_000_000, ".75": 750_000, "9.": 9_000_000,
    "\t8 ": 8_000_000, " 2\ufeff": 2_000_000, ".": 0, "-": 0, "+": 0, "": None, "   ": None, "3e4": None,
    "7.8.9": None, "12 tokens": None, "+-2": None, "4 4": None, "5\n": 5_000_000, "٣": None,
    "0." + "2" * 50: 222_222, "9223372036854.775807": 2**63 - 1, "9223372036854.775808": None, "7" * 40: None,
}


def test_text_to_micros(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.m for r in df.select("t", micros_from_text(F.col("t")).alias("m")).collect()}
    assert got == TEXTS


def test_numbers_round_half_up_and_exact_mode_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(1.5,), (-0.0000005,), (1.1001115,), (float("nan"),), (float("inf"),)], "d double")
    rows = df.select(
        micros_from_number(F.col("d")).alias("a"), micros_from_binary_double(F.col("d")).alias("b")
    ).collect()
    assert [r.a for r in rows] == [1_500_000, -1, 1_100_112, None, None]
    assert [r.b for r in rows] == [1_500_000, 0, 1_100_111, None, None]


def test_format_and_pretty(spark):
    values = [0, 7, -40, 61_250_000, 8_800_000_000_000, -3_000_001, 10**36 + 3, -(10**37)]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "m decimal(38,0)")
    rows = df.select("m", format_micros(F.col("m")).alias("f"), pretty_micros(F.col("m")).alias("p")).collect()
    for r in rows:
        whole, part = divmod(abs(int(r.m)), 10**6)
        sign = "-" if r.m < 0 else ""
        assert r.f == f"{sign}{whole}.{part:06d}"
        trimmed = f"{part:06d}".rstrip("0")
        assert r.p == f"{sign}{whole:,}" + (f".{trimmed}" if trimmed else "")


@pytest.mark.parametrize("text", ["0.000000", "61.250000", "8800000.000001", "13.000000"])
def test_round_trip(spark, text):
    df = spark.range(1).select(format_micros(micros_from_text(F.lit(text))).alias("t"))
    assert df.first().t == text
