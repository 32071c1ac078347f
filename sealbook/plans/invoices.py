"""Invoices of customers from receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.functions.quantity import format_micros
from sealbook.operators.merkle import merkle_roots
from sealbook.operators.ordering import in_order
from sealbook.settings import Settings


def customer_invoices(receipts: DataFrame, settings: Settings) -> DataFrame:
    """Lines, events, total and invoice root per customer; the root is over the sorted window roots."""
    lines = in_order(
        receipts.select("customer_id", F.col("merkle_root").alias("hash")), ["customer_id"], ["hash"]
    )
    roots = merkle_roots(lines.rows, ["customer_id"], lines.largest, settings.domain)
    sums = receipts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("event_count").alias("event_count"),
        F.sum("billed_total_micros").alias("micros"),
    )
    return sums.join(roots, "customer_id").select(
        "customer_id",
        "lines",
        "event_count",
        format_micros(F.col("micros")).alias("grand_total"),
        F.col("merkle_root").alias("invoice_root"),
    )
