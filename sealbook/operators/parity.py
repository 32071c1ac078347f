"""Comparing two sets of results key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that one side lacks, or whose values differ; empty when the sides agree."""
    a = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    both = a.join(b, key, "full")
    problem = (
        F.when(F.col("in_right").isNull(), "only_left")
        .when(F.col("in_left").isNull(), "only_right")
        .when(~F.col("left_value").eqNullSafe(F.col("right_value")), "differs")
    )
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("in_left", "in_right")


def agreement(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: the number of runs, and whether all of them gave one value."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        (F.min(value) == F.max(value)).alias("all_equal"),
    )
