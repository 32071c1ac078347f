"""Sealing the windows that their stream's watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.functions.windows import STREAM


def seal_due_windows(windows: DataFrame, watermarks: DataFrame, now_ms: int) -> DataFrame:
    """All windows, due ones sealed, with ``newly_sealed`` true for those.

    Open and ``close <= watermark`` is due. Sealed windows stay as they are, so a second call
    with the same watermarks changes nothing.
    """
    due = (F.col("state") == "open") & (F.col("window_close_ms") <= F.col("watermark_ms"))
    return (
        windows.join(watermarks.select(*STREAM, "watermark_ms"), STREAM, "left")
        .withColumn("newly_sealed", F.coalesce(due, F.lit(False)))
        .select(
            "window_key",
            *STREAM,
            "window_open_ms",
            "window_close_ms",
            F.when(F.col("newly_sealed"), "sealed").otherwise(F.col("state")).alias("state"),
            F.when(F.col("newly_sealed"), F.lit(now_ms).cast("bigint"))
            .otherwise(F.col("sealed_at_ms"))
            .alias("sealed_at_ms"),
            F.when(F.col("newly_sealed"), F.col("watermark_ms"))
            .otherwise(F.col("sealed_watermark_ms"))
            .alias("sealed_watermark_ms"),
            "newly_sealed",
        )
    )


def newly_sealed(after: DataFrame, before: DataFrame) -> DataFrame:
    """Windows sealed in one snapshot and not in an earlier one."""
    sealed = F.col("state") == "sealed"
    return after.where(sealed).join(before.where(sealed).select("window_key"), "window_key", "left_anti")


def select_windows(windows: DataFrame, customer_id: str | None = None, metric: str | None = None) -> DataFrame:
    """The window list, by customer or metric if asked, in key order."""
    if customer_id is not None:
        windows = windows.where(F.col("customer_id") == customer_id)
    if metric is not None:
        windows = windows.where(F.col("metric") == metric)
    return windows.orderBy("window_key")
