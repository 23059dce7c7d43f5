"""Boxes with values from a stream into a key: each micro-batch is one bulk load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesseral.engine import Engine


def ingest(stream: DataFrame, engine: Engine, space: str, key: str, value: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a query that loads every batch of the stream (columns z, i, bounds, value) once, batches in order.

    A batch that comes again after a failure is loaded again: boxes of a value are a set, so nothing is counted twice.
    """
    load = lambda batch, _: engine.load(space, key, batch, value)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
