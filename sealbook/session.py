"""A Spark session for one machine: tests, benchmarks, trying things out."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """On a cluster use its own session; only UTC and adaptive execution are expected of it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sealbook")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.log.structuredLogging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
