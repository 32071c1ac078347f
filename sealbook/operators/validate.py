"""Checking deliveries before they are admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

from sealbook.functions.quantity import is_number, is_quantity_text, micros_from_number, micros_from_text

REASONS = {
    "event_id": "no_event_id",
    "customer_id": "no_customer_id",
    "metric": "no_metric",
    "event_time_ms": "no_event_time",
    "quantity": "not_a_quantity",
    "quantity_range": "quantity_too_large",
}

# Fixed value: the shape of a UUID, the one kind of id whose case says nothing.
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def normal_id(name: str) -> Column:
    """An id as it is compared: a UUID in lower case, so that text order is UUID order; others as given.

    The pattern is tried only where there is something to lower.
    """
    low = F.lower(name)
    return F.when((F.col(name) != low) & F.col(name).rlike(_UUID), low).otherwise(F.col(name))


def check_deliveries(df: DataFrame, now_ms: int) -> DataFrame:
    """Add ``quantity_micros`` and ``reject_reason`` (null for a valid delivery).

    UUIDs become lower case; other ids stay as given. A missing ingest time becomes ``now_ms`` and a
    missing payload an empty object. A quantity beyond a 64-bit count of micro-units has a reason of its own.
    """
    kind, quantity = df.schema["quantity"].dataType, F.col("quantity")
    numeric, exact = isinstance(kind, NumericType), isinstance(kind, DecimalType)
    reason = F.lit(None).cast("string")
    for name, problem in reversed(REASONS.items()):
        if name == "event_time_ms":
            bad = F.col(name).isNull()
        elif name == "quantity":
            # A decimal is always a number.
            bad = quantity.isNull() if exact else ~(is_number(quantity) if numeric else is_quantity_text(quantity))
        elif name == "quantity_range":
            bad = F.col("quantity_micros").isNull()
        else:
            bad = F.coalesce(F.col(name), F.lit("")) == ""
        reason = F.when(bad, problem).otherwise(reason)
    # Filters repeat the expressions of what they look at, so the reason is made of columns as given, each named once.
    return (
        df.withColumn("quantity_micros", micros_from_number(quantity) if numeric else micros_from_text(quantity))
        .withColumn("reject_reason", reason)
        .withColumn("event_id", normal_id("event_id"))
        .withColumn("customer_id", normal_id("customer_id"))
        .withColumn("ingest_time_ms", F.coalesce("ingest_time_ms", F.lit(now_ms).cast("bigint")))
        .withColumn("payload", F.coalesce("payload", F.lit("{}")))
    )


def valid_deliveries(df: DataFrame, now_ms: int, strict: bool = False) -> DataFrame:
    """The valid deliveries. With ``strict`` one invalid delivery fails the whole job."""
    checked = check_deliveries(df, now_ms)
    ok = F.col("reject_reason").isNull()
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.col("reject_reason")).cast("boolean"))
    return checked.where(ok).drop("reject_reason")


def rejected_deliveries(df: DataFrame, now_ms: int) -> DataFrame:
    return check_deliveries(df, now_ms).where(F.col("reject_reason").isNotNull())
