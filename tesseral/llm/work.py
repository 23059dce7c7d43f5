"""Shared folder, intermediate tables and size-checked broadcasts for the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table of keys and a few numbers that are sent to every executor.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own if it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        folder = tempfile.mkdtemp(prefix="tesseral-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder, written once, read back with known sizes, and dropped when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._end)

    def write(self, frame: DataFrame, name: str, **options: str) -> DataFrame:
        """The frame as a Parquet table: lineage ends here, and a lost executor costs a re-read only."""
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.drop()
        except Exception:  # the session may be gone at exit
            pass


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only if the frame, a written table, holds at most so many rows; else Spark shuffles it."""
    return F.broadcast(frame) if len(frame.limit(rows + 1).select(F.lit(1)).take(1)) == 0 or frame.count() <= rows else frame
