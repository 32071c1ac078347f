"""Watermarks per stream. ``withWatermark`` is one value per query, so it is not used here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.functions.windows import STREAM


def stream_watermarks(events: DataFrame, grace_ms: int) -> DataFrame:
    """Latest admitted event time minus the grace, per stream."""
    return events.groupBy(*STREAM).agg(
        (F.max("event_time_ms") - F.lit(grace_ms).cast("bigint")).alias("watermark_ms"),
        F.lit(grace_ms).cast("bigint").alias("lateness_grace_ms"),
    )


def advance_watermarks(held: DataFrame | None, seen: DataFrame) -> DataFrame:
    """Upsert that never moves a watermark back; the grace is the one last used."""
    if held is None:
        return seen
    old = held.select(*STREAM, F.col("watermark_ms").alias("old_ms"), F.col("lateness_grace_ms").alias("old_grace"))
    return old.join(seen, STREAM, "full").select(
        *STREAM,
        F.greatest("old_ms", "watermark_ms").alias("watermark_ms"),
        F.coalesce("lateness_grace_ms", "old_grace").alias("lateness_grace_ms"),
    )
