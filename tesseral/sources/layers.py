"""Layers over the driver's tables: events, orders, line items, and two small spatial regions, as boxes with values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.model import BOX, FINEST, FOREVER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(df: DataFrame, z: int, i: int, spans: dict[str, tuple[Column, Column]], *values: Column) -> DataFrame:
    """df's rows as boxes: inclusive spans of steps of f, x, y and t (without t: all time)."""
    unit = 1 << (FINEST - z)
    columns = [F.lit(z).cast("int").alias("z"), F.lit(i).cast("long").alias("i")]
    for d in "fxy":
        lo, hi = spans[d]
        columns += [(lo.cast("long") * unit).alias(f"{d}_lo"), ((hi.cast("long") + 1) * unit).alias(f"{d}_hi")]
    if "t" in spans:
        columns += [(spans["t"][0].cast("long") * i).alias("t_lo"), ((spans["t"][1].cast("long") + 1) * i).alias("t_hi")]
    else:
        columns += [F.lit(0).cast("long").alias("t_lo"), F.lit(FOREVER).cast("long").alias("t_hi")]
    return df.select(*values, *columns)


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _one(c: Column) -> tuple[Column, Column]:
    return c, c


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell and hour per event; event_id, event_type, value."""
    height = F.least(F.floor(F.col("value") / 4).cast("long"), F.lit(319)) - 64
    spans = {"f": _one(height), "x": _one(F.col("user_id") % 256), "y": _one(F.col("event_id") % 256), "t": _one(F.expr("unix_seconds(cast(ts as timestamp)) div 3600"))}
    return boxes(table(spark, sf_dir, "events"), 8, 3600, spans, F.col("event_id"), F.col("event_type"), F.col("value"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of cells and a week per order; o_orderkey, o_orderpriority, o_orderstatus."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    day = F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 86400")
    spans = {"f": (-(k % 4), c % 4), "x": (c % 240, c % 240 + c % 8), "y": (k % 240, k % 240 + k % 5), "t": (day, day + 6)}
    return boxes(table(spark, sf_dir, "orders"), 8, 86400, spans, k, F.col("o_orderpriority"), F.col("o_orderstatus"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell and day per line; l_orderkey, l_linenumber, l_quantity."""
    day = F.expr("unix_seconds(cast(l_shipdate as timestamp)) div 86400")
    spans = {"f": _one(F.col("l_linenumber") - 4), "x": _one(F.col("l_partkey") % 256), "y": _one(F.col("l_suppkey") % 256), "t": _one(day)}
    return boxes(table(spark, sf_dir, "lineitem"), 8, 86400, spans, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int").alias("l_quantity"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region A: a spatial box at zoom 5 per supplier."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    spans = {"f": (-(k % 5), k % 3), "x": (k % 31, k % 31 + 1), "y": (n, n + 2)}
    return boxes(table(spark, sf_dir, "supplier"), 5, 0, spans)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region B: a spatial box at zoom 5 per customer."""
    k = F.col("c_custkey")
    spans = {"f": (k % 6 - 1, k % 6), "x": _one(k % 29), "y": _one(F.col("c_nationkey") + k % 3)}
    return boxes(table(spark, sf_dir, "customer"), 5, 0, spans)


def region_of(df: DataFrame) -> DataFrame:
    return df.select("z", "i", *BOX)
