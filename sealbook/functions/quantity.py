"""Exact quantities: decimal text to micro-units and back, all in built-in expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space cut from both ends of a quantity, the shape of a quantity.
_BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
_SHAPE = r"^(?<sign>[+-]?)(?<whole>[0-9]*)(?:\.(?<part>[0-9]*))?\z"

_SCALE = 1_000_000


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}\\z", "")


def is_quantity_text(text: Column) -> Column:
    """Whether a string has the shape of a quantity, however large; false for null."""
    cut = trim_blank(text)
    return F.coalesce((cut != "") & cut.rlike(_SHAPE), F.lit(False))


def is_number(number: Column) -> Column:
    """Whether a numeric value is finite; false for null."""
    value = number.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def micros_from_text(text: Column) -> Column:
    """Micro-units of a decimal string; null where it is not one or does not fit a long.

    Exponents are refused, and a bare sign or point counts as zero. Zeros around the digits
    make every accepted shape a literal that the decimal cast takes, which rounds half up on
    the magnitude.
    """
    cut = trim_blank(text)
    padded = F.regexp_replace(cut, _SHAPE, "${sign}0${whole}.${part}0")
    value = padded.try_cast("decimal(20,6)")
    return F.when((cut != "") & cut.rlike(_SHAPE), (value * _SCALE).try_cast("bigint"))


def micros_from_number(number: Column) -> Column:
    """Micro-units of a numeric column. Doubles are rounded from their shortest decimal."""
    return (number.try_cast("decimal(20,6)") * _SCALE).try_cast("bigint")


def micros_from_binary_double(number: Column) -> Column:
    """Opt-in: rounds the exact binary value of a double instead of its shortest decimal."""

    @F.pandas_udf("bigint")
    def exact(numbers: pd.Series) -> pd.Series:
        return numbers.map(_binary_micros).astype("Int64")

    return exact(number)


def _binary_micros(x: float) -> int | None:
    if pd.isna(x) or abs(x) >= 2**63 / _SCALE:
        return None
    return int(Decimal(x).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))


def money(micros: Column) -> Column:
    """Micro-units of one row as decimal(38,6)."""
    return (micros.cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,6)")


def format_micros(micros: Column) -> Column:
    """Canonical text with exactly six decimals, for longs and for sums of any size."""
    exact = micros.cast("decimal(38,0)")
    digits = F.abs(exact).cast("string")
    digits = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    sign = F.when(exact < 0, "-").otherwise("")
    return F.concat(sign, F.regexp_replace(digits, r"^(\d+)(\d{6})$", "$1.$2"))


def pretty_micros(micros: Column) -> Column:
    """Thousands separators and no trailing zeros."""
    text = format_micros(micros)
    grouped = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), r"(?<=\d)(?=(\d{3})+$)", ",")
    part = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", "")
    return F.when(part == "", grouped).otherwise(F.concat_ws(".", grouped, part))


def exact_sum(micros: Column) -> Column:
    """Sum that neither overflows nor rounds."""
    return F.sum(micros.cast("decimal(28,0)"))
