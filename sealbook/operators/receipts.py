"""Receipts: what is committed to when a window is sealed, and the bundles that prove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealbook.functions.hashing import hmac_sha256, leaf_hash, leaf_text
from sealbook.functions.quantity import format_micros
from sealbook.functions.windows import STREAM, TOTAL_ORDER, billing_mode, with_window
from sealbook.operators.merkle import merkle_roots
from sealbook.operators.ordering import Ordered, in_order
from sealbook.schemas import MICROS_SUM
from sealbook.settings import LEAF_ORDER_RULE, RECEIPT_ALGO, Settings

# Leaves in one bundle row. A window with more of them is exported as several rows.
BUNDLE_LEAVES = 65_536


def sealed_leaves(
    log: DataFrame, sealed: DataFrame, settings: Settings, rows_per_task: int | None = None
) -> Ordered:
    """The events of the given sealed windows, each with its ``position`` in the total order.

    What a receipt says of its window comes along from the few rows of the windows.
    """
    bounds = sealed.where(F.col("state") == "sealed").select("window_key", *STREAM, "sealed_watermark_ms")
    events = with_window(log, settings.window_ms).select("window_key", *TOTAL_ORDER, "quantity_micros")
    inside = events.join(bounds, "window_key").where(F.col("event_time_ms") <= F.col("sealed_watermark_ms"))
    # Counted before the join, where a window with very many events is still summed in parts.
    counts = events.groupBy("window_key").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.join(bounds, "window_key", "left_semi")
    return in_order(inside, ["window_key"], TOTAL_ORDER, rows_per_task=rows_per_task, sizes=sizes)


def leaf_hashes(leaves: DataFrame, settings: Settings) -> DataFrame:
    text = leaf_text(F.col("event_id"), F.col("event_time_ms"), F.col("quantity_micros"))
    return leaves.withColumn("hash", leaf_hash(text, settings.domain))


def signature(root: Column, settings: Settings) -> Column:
    return hmac_sha256(root, settings.receipt_key)


def build_receipts(leaves: Ordered, settings: Settings, created_at_ms: int) -> DataFrame:
    """One receipt per sealed window that has leaves; root and totals are folded in one pass."""
    window = ["window_key", *STREAM, "sealed_watermark_ms"]
    hashed = leaf_hashes(leaves.rows, settings).select(
        *window,
        "position",
        "hash",
        F.col("quantity_micros").cast("decimal(28,0)").alias("sum_micros"),
        F.lit(1).cast("bigint").alias("event_count"),
        F.col("quantity_micros").alias("last_micros"),
    )
    folded = merkle_roots(hashed, window, leaves.largest, settings.domain, ("sum_micros", "event_count"), ("last_micros",))
    mode = billing_mode(F.col("metric"), settings)
    last, total = F.col("last_micros").cast(MICROS_SUM), F.col("sum_micros").cast(MICROS_SUM)
    return folded.select(
        "window_key",
        *STREAM,
        mode.alias("mode"),
        "merkle_root",
        signature(F.col("merkle_root"), settings).alias("signature"),
        F.when(mode == "gauge", last).otherwise(total).alias("billed_total_micros"),
        "event_count",
        "sealed_watermark_ms",
        F.lit(LEAF_ORDER_RULE).alias("leaf_order_rule"),
        F.lit(RECEIPT_ALGO).alias("algo"),
        F.lit(created_at_ms).cast("bigint").alias("created_at_ms"),
    )


def bundles(receipts: DataFrame, leaves: DataFrame, bundle_leaves: int = BUNDLE_LEAVES) -> DataFrame:
    """Receipt and ordered leaves per window, in the shape of the audit file.

    ``firstLeaf`` is the position of the row's first leaf: 0, unless the window is so large that
    its leaves go out in several rows. So no array grows with the window.
    """
    first = F.col("position") - F.pmod("position", F.lit(bundle_leaves))
    leaf = F.struct(
        F.col("event_id").alias("eventId"),
        F.col("event_time_ms").alias("eventTimeMs"),
        F.col("quantity_micros").cast("string").alias("quantityMicros"),
    )
    parts = (
        leaves.groupBy("window_key", first.alias("firstLeaf"))
        .agg(F.sort_array(F.collect_list(F.struct("position", leaf.alias("leaf")))).alias("ordered"))
        .select("window_key", "firstLeaf", F.col("ordered.leaf").alias("leaves"))
    )
    return parts.join(receipts, "window_key").select(bundle_receipt().alias("receipt"), "firstLeaf", "leaves")


def bundle_receipt() -> Column:
    return F.struct(
        F.col("window_key").alias("windowKey"),
        F.col("customer_id").alias("customerId"),
        "metric",
        "mode",
        F.col("sealed_watermark_ms").alias("sealedWatermark"),
        F.col("billed_total_micros").cast("string").alias("billedTotalMicros"),
        format_micros(F.col("billed_total_micros")).alias("billedTotal"),
        F.col("event_count").alias("eventCount"),
        F.col("merkle_root").alias("merkleRoot"),
        "signature",
        F.col("leaf_order_rule").alias("leafOrderRule"),
        "algo",
        F.col("created_at_ms").alias("createdAtMs"),
    )
