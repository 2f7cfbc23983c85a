"""What several operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a session on this machine alone may be without that setting (a local test): it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """The folder as the JVM knows it, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a place that outlives a lost executor. The table goes when the driver's JVM ends.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gridfold/{name}-{uuid.uuid4().hex}"
    where, files = _place(df.sparkSession, path)
    files.deleteOnExit(where)
    return _write(df, path)


class Scratch:
    """Tables in the shared folder that go together, once what is made from them has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/gridfold/{name}-{uuid.uuid4().hex}"
        where, files = _place(spark, self.path)
        files.deleteOnExit(where)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def drop(self) -> None:
        where, files = _place(self.spark, self.path)
        files.delete(where, True)
