"""Positions and running sums in a given order, also for groups too large for one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealbook.operators.durable import durable

# A group up to this many rows is ordered by one task; larger ones are cut into ranges.
ROWS_PER_TASK = 1_000_000
# Ranges beyond this number would weigh on the driver; they get longer instead.
MOST_RANGES = 20_000


@dataclass(frozen=True)
class Ordered:
    rows: DataFrame
    largest: int  # rows of the largest group


def in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    running: dict[str, Column] | None = None,
    rows_per_task: int | None = None,
    sizes: DataFrame | None = None,
) -> Ordered:
    """Add ``position`` (from 0) within ``keys``, and a running sum for each named column.

    The group sizes are counted first. If every group fits one task, one window function does it.
    Groups that are larger are range-partitioned by keys and order, numbered inside each range, and
    shifted by what the ranges before them hold. ``sizes`` (``keys`` and ``n``, at least the rows
    of each group) saves counting ``df`` itself.
    """
    running = running or {}
    limit = rows_per_task or ROWS_PER_TASK
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    largest, total = largest or 0, total or 0
    if largest <= limit:
        return Ordered(_number(df, keys, order, running), largest)

    # Only groups over the limit are cut; the others stay with the window function.
    small = None
    if keys:
        over = sizes.where(F.col("n") > limit)
        total = over.agg(F.sum("n")).first()[0]
        small, df = df.join(over.select(*keys), keys, "left_anti"), df.join(over.select(*keys), keys, "left_semi")
    spark = df.sparkSession
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // limit))
    # The range bounds are sampled, so the ranges are written once and only read from then on.
    cut = durable(df.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()))
    held = cut.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in running.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_shift_{name}") for name in running],
    )
    inside = _number(cut, [*keys, "_range"], order, running)
    moved = inside.join(shifts, [*keys, "_range"]).select(
        *df.columns,
        (F.col("position") + F.col("_shift")).alias("position"),
        *[(F.col(name) + F.col(f"_shift_{name}")).alias(name) for name in running],
    )
    if small is not None:
        moved = _number(small, keys, order, running).unionByName(moved)
    return Ordered(moved, largest)


def _number(df: DataFrame, keys, order, running) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        (F.row_number().over(by) - 1).cast("bigint").alias("position"),
        *[F.sum(c).over(upto).alias(name) for name, c in running.items()],
    )
