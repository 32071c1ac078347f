"""Writing an intermediate result once, where every executor can read it again."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, the folder set on the context counts; failing that a session on one
    machine gets a local folder, and a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = held.get()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sealbook-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/sealbook-{uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of what was shuffled for tables that are written by now.

    Spark deletes such files once the JVM notices that nothing refers to them, which on a driver with little to do
    can be long after the disks are full. To be called between large steps.
    """
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table that survives lost executors."""
    return _write(df, shared_folder(df.sparkSession))


class Scratch:
    """Intermediates of one call, written like `durable` does and removed when the call ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_folder(self.spark))
        return _write(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
