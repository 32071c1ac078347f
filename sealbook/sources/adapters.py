"""Deliveries made from general tables: an event table, and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.settings import DAY_MS


def epoch_ms(ts: Column) -> Column:
    """Floor of epoch milliseconds of a timestamp without time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("bigint")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hex(number: Column, width: int) -> Column:
    # Zero padded, so that text order is number order.
    return F.lpad(F.lower(F.hex(number)), width, "0")


def _draw(text: Column, at: int) -> Column:
    """A number from 0 to 65535 out of a text's md5."""
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("bigint")


def events_as_deliveries(spark: SparkSession, folder: str, customers: int | None = None) -> DataFrame:
    """Rows of ``events``, all of them: user is customer, type is metric, views are a gauge.

    Ingest time wobbles by 1.5 s around event time, and for one event in ten it is up to three
    days late. ``customers`` folds users together into deeper streams.
    """
    e = table(spark, folder, "events")
    t = epoch_ms(F.col("ts"))
    id_text = F.col("event_id").cast("string")
    late = F.when(_draw(id_text, 5) % 10 == 0, _draw(id_text, 9) * 3956).otherwise(F.lit(0))
    user = F.col("user_id") if customers is None else F.pmod("user_id", F.lit(customers))
    return e.select(
        F.concat(F.lit("00000000-0000-7000-8000-"), _hex(F.col("event_id"), 12)).alias("event_id"),
        user.cast("string").alias("customer_id"),
        F.when(F.col("event_type") == "view", "view_gauge").otherwise(F.col("event_type")).alias("metric"),
        F.col("value").try_cast("decimal(20,6)").alias("quantity"),
        t.alias("event_time_ms"),
        (t + _draw(id_text, 1) % 3001 - 1500 + late).alias("ingest_time_ms"),
        F.col("props").alias("payload"),
    ).withColumn("arrival", F.struct("ingest_time_ms", "event_time_ms", "event_id"))


def lineitem_as_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``lineitem``: the supplier is the customer, the return flag the metric.

    Order and line number make the id. They repeat with other contents, so this input has
    re-deliveries, conflicts and ties of whole days.
    """
    line = table(spark, folder, "lineitem")
    t = epoch_ms(F.col("l_shipdate"))
    return line.select(
        F.concat(
            F.lit("00000000-0000-7000-"), _hex(F.col("l_linenumber"), 4), F.lit("-"), _hex(F.col("l_orderkey"), 12)
        ).alias("event_id"),
        F.col("l_suppkey").cast("string").alias("customer_id"),
        F.col("l_returnflag").alias("metric"),
        F.col("l_quantity").try_cast("decimal(20,6)").alias("quantity"),
        t.alias("event_time_ms"),
        (t + DAY_MS).alias("ingest_time_ms"),
        F.lit("{}").alias("payload"),
        F.struct(
            "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ).alias("arrival"),
        F.col("l_linestatus").alias("part"),
    )
