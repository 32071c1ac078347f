"""Joining a side with hot keys to a side that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is hot, and spread over a task for each so many rows.
ROWS_PER_SALT = 100_000


def join_hot(many: DataFrame, one: DataFrame, key: str, spread_by, copies: str, rows_per_salt: int | None = None) -> DataFrame:
    """Left join of ``many`` to ``one`` on ``key``; rows of hot keys are spread over tasks.

    ``one`` has unique keys, and in ``copies`` how many rows ``many`` has of each. So what is hot is exact and
    the same on both sides; the salts follow the count. ``copies`` is not in the result.
    """
    limit = rows_per_salt or ROWS_PER_SALT
    salts = F.ceil(F.coalesce(copies, F.lit(1)) / limit).cast("bigint")
    hot = one.where(F.col(copies) > limit).select(key, salts.alias("_salts"))
    salted = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))))
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(salts, F.lit(1)) - 1)))
    return salted.drop("_salts").join(spread.drop(copies), [key, "_salt"], "left").drop("_salt")
