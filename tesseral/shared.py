"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where it is unset, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tesseral-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


class Table:
    """Rows written once, and read as often as needed: lineage ends here, and a lost executor costs a re-read only."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        atexit.register(_drop, self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self.path)

    def drop(self) -> None:
        _drop(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table of their own, which stays until the session ends."""
    return Table(df, name).read()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit
        pass
