"""Delivery sources: JSON or Parquet files as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.schemas import DELIVERY

# Field names of delivery JSON, by our column.
JSON_FIELDS = {
    "event_id": "eventId", "customer_id": "customerId", "metric": "metric", "quantity": "quantity",
    "event_time_ms": "eventTime", "ingest_time_ms": "ingestTime", "payload": "payload",
}


# A line that is no JSON ends up in the rejects, with its text as payload.
_UNREADABLE = "_unreadable"


def _json_schema() -> str:
    kinds = {f.name: f.dataType.simpleString() for f in DELIVERY.fields}
    fields = [f"{field} {kinds[name]}" for name, field in JSON_FIELDS.items()]
    return ", ".join([*fields, f"{_UNREADABLE} string"])


def file_arrival():
    """Arrival order of file input: file time, then place in the file; unique per row."""
    return F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of deliveries; numbers keep their digits because quantity is read as text."""
    raw = spark.read.schema(_json_schema()).option("columnNameOfCorruptRecord", _UNREADABLE).json(path)
    return _with_line_arrival(raw)


def stream_json(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The same as a stream; ``max_files`` per trigger is the admission limit of one batch."""
    raw = (
        spark.readStream.schema(_json_schema()).option("columnNameOfCorruptRecord", _UNREADABLE)
        .option("maxFilesPerTrigger", max_files).json(path)
    )
    return _with_line_arrival(raw)


def _with_line_arrival(raw: DataFrame) -> DataFrame:
    # Splits are placed by file time, file and offset, and their lines numbered in order. A stream cannot number
    # lines; the store does it, for whatever it is given, when it writes a batch down.
    place = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
    place = F.struct(*place, *([] if raw.isStreaming else [F.monotonically_increasing_id().alias("line")]))
    columns = [F.col(field).alias(name) for name, field in JSON_FIELDS.items() if name != "payload"]
    payload = F.coalesce(JSON_FIELDS["payload"], _UNREADABLE).alias("payload")
    return raw.select(*columns, payload, place.alias("arrival"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELIVERY).parquet(path).withColumn("arrival", file_arrival())


def stream_parquet(spark: SparkSession, path: str, schema=DELIVERY, max_files: int = 1) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows if "arrival" in schema.fieldNames() else rows.withColumn("arrival", file_arrival())
