"""Epoch-aligned billing windows, stream identity and the total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealbook.settings import DAY_MS, Settings

STREAM = ["customer_id", "metric"]
TOTAL_ORDER = ["event_time_ms", "event_id"]


def window_open(t: Column, window_ms: int | str) -> Column:
    """Start of the window; floors, so times before the epoch go down."""
    if window_ms == "month":
        return F.unix_date(F.trunc(_utc_date(t), "month")).cast("bigint") * DAY_MS
    return t - F.pmod(t, F.lit(window_ms).cast("bigint"))


def window_close(opened: Column, window_ms: int | str) -> Column:
    if window_ms == "month":
        return F.unix_date(F.add_months(_utc_date(opened), 1)).cast("bigint") * DAY_MS
    return opened + F.lit(window_ms).cast("bigint")


def _utc_date(t: Column) -> Column:
    # Whole days since the epoch, so the session time zone plays no part.
    day = (t - F.pmod(t, F.lit(DAY_MS).cast("bigint"))) / DAY_MS
    return F.date_from_unix_date(day.cast("int"))


def window_key(customer: Column, metric: Column, opened: Column) -> Column:
    return F.concat_ws(":", customer, metric, opened.cast("string"))


def with_window(df: DataFrame, window_ms: int | str) -> DataFrame:
    """Add ``window_key``, ``window_open_ms`` and ``window_close_ms``."""
    opened = window_open(F.col("event_time_ms"), window_ms)
    return (
        df.withColumn("window_open_ms", opened)
        .withColumn("window_close_ms", window_close(F.col("window_open_ms"), window_ms))
        .withColumn("window_key", window_key(F.col("customer_id"), F.col("metric"), F.col("window_open_ms")))
    )


def metric_of_key(key: Column) -> Column:
    """The metric inside a window key, empty where there is none."""
    return F.split_part(key, F.lit(":"), F.lit(2))


def billing_mode(metric: Column, settings: Settings) -> Column:
    gauge = metric.isin(*settings.gauge_metrics) | metric.endswith(settings.gauge_suffix)
    return F.when(gauge, "gauge").otherwise("counter")


def total_order() -> Column:
    return F.struct(*TOTAL_ORDER)


def event_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)
