"""Billed totals of all windows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealbook.functions.quantity import exact_sum, format_micros
from sealbook.functions.windows import (
    STREAM,
    TOTAL_ORDER,
    billing_mode,
    metric_of_key,
    total_order,
    window_close,
    window_key,
    window_open,
    with_window,
)
from sealbook.operators.ordering import in_order
from sealbook.schemas import MICROS_SUM
from sealbook.settings import Settings

# What identifies a window; its key text and its close follow from these.
WINDOW_ID = [*STREAM, "window_open_ms"]


def _per_window(events: DataFrame, settings: Settings, **values: Column) -> DataFrame:
    opened = window_open(F.col("event_time_ms"), settings.window_ms)
    grouped = events.withColumn("window_open_ms", opened).groupBy(*WINDOW_ID)
    totals = grouped.agg(*[value.alias(name) for name, value in values.items()])
    return totals.select(
        window_key(*[F.col(c) for c in WINDOW_ID]).alias("window_key"),
        *WINDOW_ID,
        window_close(F.col("window_open_ms"), settings.window_ms).alias("window_close_ms"),
        *values,
    )


def _counter(**more: Column) -> dict[str, Column]:
    return {"total_micros": exact_sum(F.col("quantity_micros")), "event_count": F.count(F.lit(1)), **more}


def _gauge(order: Column, **more: Column) -> dict[str, Column]:
    return {"total_micros": _last(order), "event_count": F.count(F.lit(1)), **more}


def counter_totals(events: DataFrame, settings: Settings) -> DataFrame:
    """Exact sum and count per window; summed before the shuffle."""
    return _per_window(events, settings, **_counter())


def gauge_totals(events: DataFrame, settings: Settings) -> DataFrame:
    """Last value under the total order; a maximum, so it needs no sorted window."""
    return _per_window(events, settings, **_gauge(total_order()))


def gauge_totals_by_arrival(events: DataFrame, settings: Settings) -> DataFrame:
    """Diagnostic only: ties on the last time go to whichever event arrived last."""
    return _per_window(events, settings, **_gauge(F.struct("event_time_ms", "arrival")))


def _last(order: Column) -> Column:
    return F.max_by("quantity_micros", order).cast(MICROS_SUM)


def billed_totals(events: DataFrame, settings: Settings, **more: Column) -> DataFrame:
    """Per window the sum or the last value, whichever its metric is billed by.

    Counters and gauges part before the aggregation, so that counters, the bulk of usage, keep
    the hash aggregate, and their scan never reads the ids that only gauges need.
    """
    mode = billing_mode(F.col("metric"), settings)
    counters = _per_window(events.where(mode == "counter"), settings, **_counter(**more))
    gauges = _per_window(events.where(mode == "gauge"), settings, **_gauge(total_order(), **more))
    return counters.withColumn("mode", F.lit("counter")).unionByName(gauges.withColumn("mode", F.lit("gauge")))


def bill_log(events: DataFrame, settings: Settings) -> DataFrame:
    """Windows, seals and totals of a whole log in one pass, as if sealed once at its end.

    The watermark of a stream is the latest of its windows' latest times, so after the totals
    only one row per window is moved again.
    """
    billed = billed_totals(events, settings, latest_ms=F.max("event_time_ms"))
    marked = _with_watermark(billed, settings)
    return _totals_of(marked, settings)


def windows_of_log(events: DataFrame, settings: Settings, now_ms: int) -> DataFrame:
    """The window registry of a whole log with the state after one seal at its end, in one pass."""
    seen = _per_window(events, settings, latest_ms=F.max("event_time_ms"))
    return _with_watermark(seen, settings).select(
        "window_key",
        *STREAM,
        "window_open_ms",
        "window_close_ms",
        "state",
        F.when(F.col("state") == "sealed", F.lit(now_ms).cast("bigint")).alias("sealed_at_ms"),
        "sealed_watermark_ms",
    )


def _with_watermark(per_window: DataFrame, settings: Settings) -> DataFrame:
    mark = F.max("latest_ms").over(Window.partitionBy(*STREAM)) - F.lit(settings.grace_ms).cast("bigint")
    due = F.col("window_close_ms") <= F.col("watermark_ms")
    return (
        per_window.withColumn("watermark_ms", mark)
        .withColumn("state", F.when(due, "sealed").otherwise("open"))
        .withColumn("sealed_watermark_ms", F.when(due, F.col("watermark_ms")))
    )


def window_totals(
    events: DataFrame, windows: DataFrame, settings: Settings, hand_made_windows: bool = False
) -> DataFrame:
    """The billed total of every window in the registry.

    A window sealed by its watermark closes before it, so its events need no second bound.
    Windows from elsewhere, with other lengths or an early watermark, take the range join.
    """
    if hand_made_windows:
        joined = range_window_join(events, windows)
        mode = billing_mode(F.col("metric"), settings)
        value = F.when(mode == "gauge", _last(total_order())).otherwise(exact_sum(F.col("quantity_micros")))
        totals = joined.groupBy("window_key", "metric").agg(
            value.alias("total_micros"), F.count(F.lit(1)).alias("event_count")
        )
    else:
        totals = billed_totals(events, settings)
    per_window = totals.select("window_key", "total_micros", "event_count")
    return _totals_of(windows.join(per_window, "window_key", "left"), settings)


def totals_for_keys(keys: DataFrame, totals: DataFrame, settings: Settings) -> DataFrame:
    """Totals of the asked ``window_key`` rows; an unknown key is an open window with zero."""
    known = totals.select(
        "window_key", "billed_total_micros", "event_count", "sealed", "sealed_watermark_ms"
    )
    return keys.select("window_key").join(known, "window_key", "left").select(
        "window_key",
        F.coalesce("billed_total_micros", F.lit("0")).alias("billed_total_micros"),
        format_micros(F.coalesce("billed_total_micros", F.lit("0")).cast(MICROS_SUM)).alias("billed_total"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        billing_mode(metric_of_key(F.col("window_key")), settings).alias("mode"),
        F.coalesce("sealed", F.lit(False)).alias("sealed"),
        "sealed_watermark_ms",
    )


def _totals_of(windows: DataFrame, settings: Settings) -> DataFrame:
    micros = F.coalesce(F.col("total_micros"), F.lit(0).cast(MICROS_SUM)).cast(MICROS_SUM)
    return windows.select(
        "window_key",
        *STREAM,
        "window_open_ms",
        "window_close_ms",
        billing_mode(F.col("metric"), settings).alias("mode"),
        format_micros(micros).alias("billed_total"),
        micros.cast("string").alias("billed_total_micros"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        (F.col("state") == "sealed").alias("sealed"),
        "sealed_watermark_ms",
    )


def range_window_join(events: DataFrame, windows: DataFrame, slice_ms: int | None = None) -> DataFrame:
    """Events joined to windows of any length: same stream, ``open <= t < close``, not past the seal.

    Each window is listed under the time slices it touches, so the join is an equi join on
    stream and slice and a long-lived stream spreads over many tasks. A slice is as long as the
    average window, which keeps the list within three rows per window.
    """
    if slice_ms is None:
        mean = windows.agg(F.avg(F.col("window_close_ms") - F.col("window_open_ms"))).first()[0]
        slice_ms = max(int(mean or 1), 1)
    width = F.lit(slice_ms).cast("bigint")
    first = (F.col("window_open_ms") - F.pmod("window_open_ms", width)) / slice_ms
    last_ms = F.col("window_close_ms") - 1
    last = (last_ms - F.pmod(last_ms, width)) / slice_ms
    listed = windows.withColumn("_slice", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    t = F.col("event_time_ms")
    sliced = events.withColumn("_slice", ((t - F.pmod(t, width)) / slice_ms).cast("bigint"))
    bounded = (F.col("state") != "sealed") | F.col("sealed_watermark_ms").isNull() | (t <= F.col("sealed_watermark_ms"))
    return (
        sliced.join(listed, [*STREAM, "_slice"])
        .where((t >= F.col("window_open_ms")) & (t < F.col("window_close_ms")) & bounded)
        .drop("_slice")
    )


def running_totals(events: DataFrame, settings: Settings, rows_per_task: int | None = None) -> DataFrame:
    """Every event with the running sum of its window up to it, in the total order."""
    return in_order(
        with_window(events, settings.window_ms),
        ["window_key"],
        TOTAL_ORDER,
        running={"running_micros": F.col("quantity_micros").cast("decimal(28,0)")},
        rows_per_task=rows_per_task,
    ).rows


def latest_events(events: DataFrame, settings: Settings) -> DataFrame:
    """The last event of each window under the total order, as whole rows.

    Spark keeps only the best row per window before the shuffle when the rank is cut at one.
    """
    last = Window.partitionBy("window_key").orderBy(F.desc("event_time_ms"), F.desc("event_id"))
    return (
        with_window(events, settings.window_ms)
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def invoice_totals(totals: DataFrame, by: list[str]) -> DataFrame:
    """Grand totals over window totals, for ``by`` or for everything when it is empty."""
    micros = F.sum(F.col("billed_total_micros").cast(MICROS_SUM))
    return totals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("event_count").alias("event_count"),
        F.coalesce(micros, F.lit(0).cast(MICROS_SUM)).alias("_micros"),
    ).select(
        *by,
        "windows",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.col("_micros").cast("string").alias("grand_total_micros"),
        format_micros(F.col("_micros")).alias("grand_total"),
    )
