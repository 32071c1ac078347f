"""Audit bundles as files: JSON lines out; one bundle, a list or an invoice object in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sealbook.schemas import BUNDLE


def write_bundles(bundles: DataFrame, path: str) -> None:
    """One bundle per line, spread over as many files as there are partitions."""
    bundles.write.mode("overwrite").json(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundle lines as written by :func:`write_bundles`."""
    return spark.read.schema(BUNDLE).json(path)


def import_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents: a bundle, a list of bundles, or ``{"windows": [...]}``, one per file.

    A list at the top is read as one row per element.
    """
    either = StructType([*BUNDLE, StructField("windows", ArrayType(BUNDLE))])
    read = spark.read.schema(either).option("multiLine", True).json(path)
    one = F.array(F.struct("receipt", "firstLeaf", "leaves"))
    return read.select(F.explode(F.coalesce("windows", one)).alias("b")).select("b.*")
