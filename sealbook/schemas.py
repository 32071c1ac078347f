"""Explicit schemas of the input and of the state tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_s, _l, _t = StringType(), LongType(), TimestampType()
MONEY = DecimalType(38, 6)
MICROS_SUM = DecimalType(38, 0)

DELIVERY = _struct(
    event_id=_s, customer_id=_s, metric=_s, quantity=_s,
    event_time_ms=_l, ingest_time_ms=_l, payload=_s,
)

EVENT_LOG = _struct(
    event_id=_s, customer_id=_s, metric=_s, quantity=MONEY, quantity_micros=_l,
    event_time_ms=_l, ingest_time_ms=_l, event_time=_t, ingest_time=_t, payload=_s,
)

STREAM_WATERMARK = _struct(customer_id=_s, metric=_s, watermark_ms=_l, lateness_grace_ms=_l)

BILLING_WINDOW = _struct(
    window_key=_s, customer_id=_s, metric=_s, window_open_ms=_l, window_close_ms=_l,
    state=_s, sealed_at_ms=_l, sealed_watermark_ms=_l,
)

CORRECTION = _struct(
    correction_id=_s, window_key=_s, event_id=_s, customer_id=_s, metric=_s,
    quantity=MONEY, quantity_micros=_l, event_time_ms=_l, quarantined_at_ms=_l, reason=_s,
)

RECEIPT = _struct(
    window_key=_s, customer_id=_s, metric=_s, mode=_s, merkle_root=_s, signature=_s,
    billed_total_micros=MICROS_SUM, event_count=_l, sealed_watermark_ms=_l,
    leaf_order_rule=_s, algo=_s, created_at_ms=_l,
)

BUNDLE_RECEIPT = _struct(
    windowKey=_s, customerId=_s, metric=_s, mode=_s, sealedWatermark=_l,
    billedTotalMicros=_s, billedTotal=_s, eventCount=_l, merkleRoot=_s, signature=_s,
    leafOrderRule=_s, algo=_s, createdAtMs=_l,
)
BUNDLE_LEAF = _struct(eventId=_s, eventTimeMs=_l, quantityMicros=_s)
BUNDLE = StructType([
    StructField("receipt", BUNDLE_RECEIPT),
    StructField("firstLeaf", LongType()),
    StructField("leaves", ArrayType(BUNDLE_LEAF)),
])

# One line of the tagged log: `t` says which of the bodies is filled.
TAGGED_LINE = StructType([
    StructField("t", StringType()),
    StructField("e", _struct(
        eventId=_s, customerId=_s, metric=_s, quantityMicros=_s,
        eventTime=_l, ingestTime=_l, payload=_s,
    )),
    StructField("windowKey", StringType()),
    StructField("sealedAt", LongType()),
    StructField("sealedWatermark", LongType()),
    StructField("c", _struct(
        correctionId=_s, windowKey=_s, eventId=_s, customerId=_s, metric=_s,
        quantity=_s, eventTime=_l, quarantinedAt=_l, reason=_s,
    )),
    StructField("r", BUNDLE_RECEIPT),
])
