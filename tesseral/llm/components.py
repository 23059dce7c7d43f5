"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm.work import Scratch


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for each end of links (a, b): the smallest id that it reaches. Lone ids do not occur.

    Each round is two shuffles of a table that never outgrows the links; it is written to the shared folder, and the
    rounds are logarithmic in the diameter. A hub's links are aggregated (min) before the shuffle into a table of one row per id; each
    then meets that row in a join of written tables, which adaptive execution may broadcast or split where a hub has many links.
    """
    edges = scratch.write(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, i = None, 0
    while True:
        # large star: every larger neighbour, and the id itself, is tied to the least neighbour
        both = edges.union(edges.select("b", "a"))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{i}-least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large.filter("a != b"), f"{name}-{i}-large")
        # small star: the smaller neighbours of an id are tied to the least of them
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{i}-last")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        i += 1
        edges = scratch.write(small.filter("a != b").distinct(), f"{name}-{i}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for done in ("", "-least", "-large", "-last"):
            scratch.drop(f"{name}-{i - 1}{done}")
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
