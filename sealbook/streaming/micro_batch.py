"""Streaming ingest: each micro-batch is one ingest call on the store, sealed at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sealbook.sources.store import MeteringStore


def start_metering(
    deliveries: DataFrame,
    store: MeteringStore,
    checkpoint: str,
    now_ms: int | None = None,
    auto_seal: bool = True,
    source: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the query; ``trigger`` is passed on, ``availableNow=True`` by default.

    Dedup is against the whole log, without a horizon, and nothing is dropped as late: late
    events are filed as corrections. The store notes batches under ``source`` (the checkpoint's path
    if not given), so a batch that Spark runs again after a failure is skipped, and other sources,
    batch loads and seals may come between. Each batch reads the clock, unless ``now_ms`` fixes it.
    """
    source = source or checkpoint

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        store.ingest(rows, now_ms, auto_seal=auto_seal, source=source, source_batch=batch_id)

    return (
        deliveries.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
