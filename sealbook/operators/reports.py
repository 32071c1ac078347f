"""Summaries for people: counts, timelines, recent corrections, clock skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealbook.functions.ids import short_id
from sealbook.functions.quantity import exact_sum, format_micros
from sealbook.functions.windows import STREAM
from sealbook.operators.ordering import ROWS_PER_TASK, in_order
from sealbook.schemas import MICROS_SUM


def billing_summary(totals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events billed, windows sealed and in all, corrections and the grand total: one row."""
    bill = totals.agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_billed"),
        F.count_if("sealed").alias("windows_sealed"),
        F.count(F.lit(1)).alias("windows"),
        F.coalesce(F.sum(F.col("billed_total_micros").cast(MICROS_SUM)), F.lit(0)).alias("micros"),
    )
    filed = corrections.agg(F.count(F.lit(1)).alias("corrections"))
    both = bill.unionByName(filed, allowMissingColumns=True)
    return both.agg(
        *[F.max(c).alias(c) for c in ("events_billed", "windows_sealed", "windows", "corrections")],
        format_micros(F.max("micros")).alias("grand_total"),
    )


def correction_summary(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("window_key", "reason").agg(
        F.count(F.lit(1)).alias("corrections"), F.sum(F.col("quantity_micros").cast("decimal(28,0)")).alias("micros")
    )


def corrections_of(corrections: DataFrame, window_key: str) -> DataFrame:
    return corrections.where(F.col("window_key") == window_key).orderBy("event_time_ms", "event_id")


def recent_corrections(corrections: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` latest corrections, ids breaking ties; a top-k that each task cuts down first."""
    return corrections.orderBy(F.desc("quarantined_at_ms"), "event_id").limit(n)


def watermark_timeline(windows: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Each window with its stream's watermark and both placed on its customer's time axis (0 to 1)."""
    axis = windows.groupBy("customer_id").agg(
        F.min("window_open_ms").alias("axis_min_ms"), F.max("window_close_ms").alias("axis_max_ms")
    )
    span = F.greatest(F.col("axis_max_ms") - F.col("axis_min_ms"), F.lit(1))

    def place(t):
        inside = F.least(F.greatest(t, F.col("axis_min_ms")), F.col("axis_max_ms"))
        return (inside - F.col("axis_min_ms")) / span

    return (
        windows.join(axis, "customer_id")
        .join(watermarks.select(*STREAM, "watermark_ms"), STREAM, "left")
        .select(
            "window_key",
            short_id(F.col("customer_id"), head=8).alias("customer_short"),
            "metric",
            "state",
            "watermark_ms",
            "axis_min_ms",
            "axis_max_ms",
            place(F.col("window_open_ms")).alias("open_at"),
            place(F.col("window_close_ms")).alias("close_at"),
            place(F.col("watermark_ms")).alias("watermark_at"),
        )
    )


def clock_skew_profile(events: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Ingest time minus event time per stream: extremes, median and 95th percentile, exact.

    Equal skews are counted first and the counts are summed up in skew order, so neither a busy
    stream nor a common skew ends up in the memory of one task.
    """
    skew = (F.col("ingest_time_ms") - F.col("event_time_ms")).alias("skew_ms")
    counted = events.groupBy(*STREAM, skew).agg(F.count(F.lit(1)).alias("n"))
    ranked = in_order(counted, STREAM, ["skew_ms"], running={"upto": F.col("n")}, rows_per_task=rows_per_task).rows
    sizes = counted.groupBy(*STREAM).agg(F.sum("n").alias("events"))

    def quantile(share: float):
        at = (F.col("events") - 1) * F.lit(share)
        low, high = [F.min(F.when(F.col("upto") > edge, F.col("skew_ms"))) for edge in (F.floor(at), F.ceil(at))]
        return low + (high - low) * F.max(at - F.floor(at))

    return ranked.join(sizes, STREAM).groupBy(*STREAM).agg(
        F.max("events").alias("events"),
        F.min("skew_ms").alias("min_skew_ms"),
        F.max("skew_ms").alias("max_skew_ms"),
        quantile(0.5).alias("median_skew_ms"),
        quantile(0.95).alias("p95_skew_ms"),
    )


def state_snapshot(totals: DataFrame, watermarks: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """The tables of one combined view of an installation, windows in key order."""
    return {
        "windows": totals.orderBy("window_key"),
        "watermarks": watermarks.orderBy(*STREAM),
        "corrections": recent_corrections(corrections),
        "streams": totals.select(*STREAM).distinct(),
        "customers": totals.select("customer_id").distinct(),
    }


def trailing_usage(
    events: DataFrame, step_ms: int, span_ms: int, key: str = "customer_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Per key and time step with events: usage in the span that ends there, and the gap to the step before.

    Events are summed into steps first. A key's steps are then cut into stretches of time of at most ``rows_per_task``
    steps (and no shorter than the span), each with a copy of those steps before it that its frames reach back to. So a key
    of any length is spread over tasks, and at most one row in two is sent twice. A gap that reaches further back than the copies
    comes from the last step of each stretch.
    """
    at = F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(step_ms).cast("bigint"))
    steps = events.groupBy(key, at.alias("at_ms")).agg(exact_sum(F.col("quantity_micros")).alias("micros"))
    length = F.lit(max(span_ms, step_ms * rows_per_task)).cast("bigint")
    into = F.pmod(F.col("at_ms"), length)
    own = ((F.col("at_ms") - into) / length).cast("bigint")
    both = F.when(into >= length - span_ms, F.array(own, own + 1)).otherwise(F.array(own))
    cut = steps.withColumn("own", own).withColumn("stretch", F.explode(both))
    order = Window.partitionBy(key, "stretch").orderBy("at_ms")
    framed = cut.select(
        key, "stretch", "own", "at_ms",
        F.sum("micros").over(order.rangeBetween(-span_ms, 0)).cast("decimal(38,0)").alias("trailing_micros"),
        F.lag("at_ms").over(order).alias("before"),
    ).where(F.col("own") == F.col("stretch"))
    ends = steps.groupBy(key, own.alias("own")).agg(F.max("at_ms").alias("end"))
    earlier = Window.partitionBy(key).orderBy("own")
    ends = ends.select(key, "own", F.lag("end").over(earlier).alias("end"))
    return framed.join(ends, [key, "own"]).select(
        key, "at_ms", "trailing_micros", (F.col("at_ms") - F.coalesce("before", "end")).alias("gap_ms")
    )


def lane(windows: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Windows with their place in the lane of their stream, by open time."""
    placed = in_order(windows, STREAM, ["window_open_ms", "window_key"], rows_per_task=rows_per_task).rows
    return placed.withColumn("place", F.col("position") + 1).drop("position")


def corrections_in_order(corrections: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """The corrections of every window with their place by event time, then id; a window may have any number of them."""
    placed = in_order(corrections, ["window_key"], ["event_time_ms", "event_id"], rows_per_task=rows_per_task).rows
    return placed.withColumn("place", F.col("position") + 1).drop("position")
