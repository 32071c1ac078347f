"""The tagged JSON-lines log: one line per event, seal, correction or receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealbook.functions.quantity import format_micros, micros_from_text, money
from sealbook.functions.windows import STREAM, with_window
from sealbook.operators.ingest import WINDOW_COLUMNS, State, log_rows, open_windows
from sealbook.operators.receipts import bundle_receipt
from sealbook.operators.watermarks import stream_watermarks
from sealbook.schemas import MICROS_SUM, TAGGED_LINE
from sealbook.settings import Settings


def tagged_lines(state: State) -> DataFrame:
    """The state as log lines in a single ``value`` column, ready for ``write.text``."""
    event = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("customer_id").alias("customerId"),
        "metric",
        F.col("quantity_micros").cast("string").alias("quantityMicros"),
        F.col("event_time_ms").alias("eventTime"),
        F.col("ingest_time_ms").alias("ingestTime"),
        "payload",
    )
    correction = F.struct(
        F.col("correction_id").alias("correctionId"),
        F.col("window_key").alias("windowKey"),
        F.col("event_id").alias("eventId"),
        F.col("customer_id").alias("customerId"),
        "metric",
        format_micros(F.col("quantity_micros")).alias("quantity"),
        F.col("event_time_ms").alias("eventTime"),
        F.col("quarantined_at_ms").alias("quarantinedAt"),
        "reason",
    )
    seal = (
        F.col("window_key").alias("windowKey"),
        F.col("sealed_at_ms").alias("sealedAt"),
        F.col("sealed_watermark_ms").alias("sealedWatermark"),
    )
    parts = [
        _lines(state.log, "event", event.alias("e")),
        _lines(state.windows.where(F.col("state") == "sealed"), "seal", *seal),
    ]
    if state.corrections is not None:
        parts.append(_lines(state.corrections, "correction", correction.alias("c")))
    if state.receipts is not None:
        parts.append(_lines(state.receipts, "receipt", bundle_receipt().alias("r")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def _lines(rows: DataFrame, tag: str, *body) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(tag).alias("t"), *body)).alias("value"))


def write_tagged_log(state: State, path: str) -> None:
    tagged_lines(state).write.mode("append").text(path)


def read_tagged_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAGGED_LINE).json(path)


def replay_state(lines: DataFrame, settings: Settings) -> State:
    """Rebuild all tables from log lines; of several seals of one window the latest counts."""
    e = lines.where(F.col("t") == "event").select("e.*").select(
        F.col("eventId").alias("event_id"),
        F.col("customerId").alias("customer_id"),
        "metric",
        F.col("quantityMicros").cast("bigint").alias("quantity_micros"),
        F.col("eventTime").alias("event_time_ms"),
        F.col("ingestTime").alias("ingest_time_ms"),
        F.coalesce("payload", F.lit("{}")).alias("payload"),
    )
    log = log_rows(e)
    latest = Window.partitionBy("windowKey").orderBy(F.desc("sealedAt"), F.desc("sealedWatermark"))
    seals = (
        lines.where(F.col("t") == "seal")
        .select("windowKey", "sealedAt", "sealedWatermark", F.row_number().over(latest).alias("n"))
        .where(F.col("n") == 1)
        .select(F.col("windowKey").alias("window_key"), "sealedAt", "sealedWatermark")
    )
    specs = with_window(log, settings.window_ms).select(*WINDOW_COLUMNS).distinct()
    windows = open_windows(specs).join(seals, "window_key", "left").select(
        *WINDOW_COLUMNS,
        F.when(F.col("sealedWatermark").isNotNull(), "sealed").otherwise("open").alias("state"),
        F.col("sealedAt").alias("sealed_at_ms"),
        F.col("sealedWatermark").alias("sealed_watermark_ms"),
    )
    micros = micros_from_text(F.col("quantity"))
    corrections = lines.where(F.col("t") == "correction").select("c.*").select(
        F.col("correctionId").alias("correction_id"),
        F.col("windowKey").alias("window_key"),
        F.col("eventId").alias("event_id"),
        F.col("customerId").alias("customer_id"),
        "metric",
        money(micros).alias("quantity"),
        micros.alias("quantity_micros"),
        F.col("eventTime").alias("event_time_ms"),
        F.col("quarantinedAt").alias("quarantined_at_ms"),
        "reason",
    )
    receipts = lines.where(F.col("t") == "receipt").select("r.*").select(
        F.col("windowKey").alias("window_key"),
        F.col("customerId").alias("customer_id"),
        "metric",
        "mode",
        F.col("merkleRoot").alias("merkle_root"),
        "signature",
        F.col("billedTotalMicros").cast(MICROS_SUM).alias("billed_total_micros"),
        F.col("eventCount").alias("event_count"),
        F.col("sealedWatermark").alias("sealed_watermark_ms"),
        F.col("leafOrderRule").alias("leaf_order_rule"),
        "algo",
        F.col("createdAtMs").alias("created_at_ms"),
    )
    return State(
        log=log,
        windows=windows,
        watermarks=stream_watermarks(log, settings.grace_ms).select(*STREAM, "watermark_ms", "lateness_grace_ms"),
        corrections=corrections,
        receipts=receipts,
    )
