"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards by a hash. Each shard's task builds one graph and stores it as rows (shard, slot, vector, ids, level,
links); links is a flat array of slots: 2 * LINKS for the ground layer, then LINKS for each layer above, -1 where
there is none. Vectors get one more component that makes all of a shard equally long, so that the nearest by inner product
are the nearest by angle, on which the graph is built. A search task reads a shard's rows, then streams queries through
it, many in lockstep in numpy; the shards' results are merged by score.

Exact copies are one vertex that carries its smallest ids, as many as a result can hold, so a large group of copies
neither fills a neighbourhood nor leaves the results. The scores that are returned are inner products in double precision of the vectors
as given; graphs of vectors of doubles are built and searched in double precision, too. Vectors of another length than the query's are never its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesseral.llm.work import Scratch

#: Links of a vertex in the upper layers, and twice as many in the ground layer.
LINKS = 12
#: Candidates that a search holds while a graph is built, and while it is queried.
BUILD_WIDTH, SEARCH_WIDTH = 48, 96
#: Vectors of one shard, about, and the least number of shards.
SHARD_ROWS, SHARDS = 20_000, 12
#: Vertices that are linked by brute force before the graph is searched, and those that are inserted at once.
FIRST, TOGETHER = 512, 256


def index_schema(kind: str = "float") -> str:
    """Columns of an index of vectors of float or double components."""
    return f"dim int, shard int, slot int, vector array<{kind}>, ids array<long>, level int, links array<int>"


def _kind(df: DataFrame, vector: str) -> str:
    """float for arrays of float, else double: vectors are kept, searched and scored as they are given."""
    return "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"



def _diverse(near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) up to ``most``: those nearer to the row's vector than to any chosen
    before; free places go to the nearest of the rest."""
    found = vectors[np.maximum(ids, 0)]
    between = found @ found.transpose(0, 2, 1)
    kept = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        closer = (kept[:, :j] & (between[:, j, :j] > near[:, j : j + 1])).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~closer & (kept[:, :j].sum(axis=1) < most)
    order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in lockstep: (similarities, ids), ``width`` per query, nearest first.

    links has a row for each vertex, entry some vertices for each query; -1 stands for none.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(links) + 1), bool)
    seen[:, -1] = True  # -1
    seen[rows, entry] = True
    ids = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, vectors.dtype)
    first = np.where(entry >= 0, np.einsum("qed,qd->qe", vectors[np.maximum(entry, 0)], queries), -np.inf)
    ids[:, : entry.shape[1]], near[:, : entry.shape[1]] = entry, first
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        at = np.argmin(done[live], axis=1)
        live, at = (x[~done[live, at]] for x in (live, at))
        if not len(live):
            break
        done[live, at] = True
        reached = links[ids[live, at]]
        fresh = ~seen[live[:, None], reached]
        seen[live[:, None], reached] = True
        reached = np.where(fresh, reached, -1)
        score = np.where(fresh, np.einsum("qed,qd->qe", vectors[np.maximum(reached, 0)], queries[live]), -np.inf)
        better = (score > near[live, -1:]).any(axis=1)
        part = live[better]
        all_near = np.concatenate((near[part], score[better]), axis=1)
        all_ids = np.concatenate((ids[part], reached[better]), axis=1)
        all_done = np.concatenate((done[part], reached[better] < 0), axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        near[part], ids[part], done[part] = (np.take_along_axis(x, order, axis=1) for x in (all_near, all_ids, all_done))
    return near, ids


@dataclass
class Graph:
    """vectors are of equal length each; layers[l] has the links of the vertices of level l and more, which come first."""

    vectors: np.ndarray
    layers: list[np.ndarray]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int64)
        for links in reversed(self.layers[1:]):
            entry = _search(self.vectors, links, queries, entry, 4)[1]
        return _search(self.vectors, self.layers[0], queries, entry, width)


def equally_long(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component, so that all are as long as the longest (then 1), in their own precision."""
    exact = vectors.astype(np.float64)
    exact /= max(float(np.abs(exact).max(initial=0)), np.finfo(np.float64).tiny)  # so that no square overflows
    squares = (exact**2).sum(axis=1)
    most = max(float(squares.max(initial=0)), np.finfo(np.float64).tiny)
    return (np.concatenate((exact, np.sqrt(np.maximum(most - squares, 0))[:, None]), axis=1) / np.sqrt(most)).astype(vectors.dtype)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Each vector at length 1, with a last component of 0."""
    exact = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(vectors.dtype).tiny).astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    return np.concatenate((exact, np.zeros((len(exact), 1))), axis=1).astype(vectors.dtype)


def _insert(vectors: np.ndarray, links: np.ndarray, rows: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
    """Links the vertices ``rows`` with the best of their candidates, and these back."""
    most = links.shape[1]
    links[rows] = _diverse(near, ids, vectors, most)
    source = np.repeat(rows, most)
    goal = links[rows].ravel()
    source, goal = source[goal >= 0], goal[goal >= 0]
    if not len(goal):
        return
    score = np.einsum("ed,ed->e", vectors[source], vectors[goal])
    order = np.lexsort((-score, goal))
    source, goal = source[order], goal[order]
    place = np.arange(len(goal)) - np.searchsorted(goal, goal)
    source, goal, place = (x[place < most] for x in (source, goal, place))  # a vertex holds no more anyway
    hubs = np.unique(goal)
    more = np.full((len(hubs), most), -1, np.int64)
    more[np.searchsorted(hubs, goal), place] = source
    more[(more[:, :, None] == links[hubs][:, None, :]).any(axis=2)] = -1
    both = np.concatenate((links[hubs], more), axis=1)
    score = np.where(both >= 0, np.einsum("hed,hd->he", vectors[np.maximum(both, 0)], vectors[hubs]), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    links[hubs] = _diverse(np.take_along_axis(score, order, axis=1), np.take_along_axis(both, order, axis=1), vectors, most)


def build(vectors: np.ndarray, levels: np.ndarray) -> Graph:
    """A graph of equally long vectors whose levels fall; every layer is built with the help of the layers above it."""
    graph = Graph(vectors, [])
    for level in range(int(levels[0]) if len(levels) else 0, -1, -1):
        n = int((levels >= level).sum())
        links = np.full((n, LINKS * (1 if level else 2)), -1, np.int64)
        first = min(n, FIRST)
        score = vectors[:first] @ vectors[:first].T
        np.fill_diagonal(score, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, : min(BUILD_WIDTH, first - 1)]
        near = np.take_along_axis(score, order, axis=1)
        _insert(vectors, links, np.arange(first), near, order)
        together = max(16, min(TOGETHER, 32_000_000 // max(n, 1)))
        for at in range(first, n, together):
            rows = np.arange(at, min(at + together, n))
            entry = np.zeros((len(rows), 1), np.int64)
            for above in graph.layers:  # the upper layers' vertices come first, and may be later than the rows
                entry = _search(vectors, above, vectors[rows], entry, 4)[1]
            entry = np.where(entry < at, entry, -1)
            entry[(entry < 0).all(axis=1), 0] = 0
            near, ids = _search(vectors, links[:at], vectors[rows], entry, BUILD_WIDTH)
            own = vectors[rows] @ vectors[rows].T
            np.fill_diagonal(own, -np.inf)
            near = np.concatenate((near, own), axis=1)
            ids = np.concatenate((ids, np.broadcast_to(rows, own.shape)), axis=1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_WIDTH]
            near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
            _insert(vectors, links, rows, near, np.where(np.isfinite(near), ids, -1))
        graph.layers.append(links)
    graph.layers.reverse()
    return graph


def _levels(n: int, seed: int) -> np.ndarray:
    """Falling levels of n vertices: each layer keeps about one of LINKS."""
    draw = np.random.default_rng(seed).random(n)
    return np.sort((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(np.int32))[::-1]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("spot", kind="stable")  # a hash: the upper layers are drawn at random
    vectors = np.stack(rows["vector"].to_numpy())
    levels = _levels(len(rows), int(rows["shard"].iloc[0]))
    graph = build(equally_long(vectors), levels)
    links = [np.concatenate([layer[i] for layer in graph.layers[: level + 1]]).astype(np.int32) for i, level in enumerate(levels.tolist())]
    slots = np.arange(len(rows), dtype=np.int32)
    return pd.DataFrame({"dim": rows["dim"].to_numpy(), "shard": rows["shard"].to_numpy(), "slot": slots, "vector": rows["vector"].to_numpy(), "ids": rows["ids"].to_numpy(), "level": levels, "links": links})


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, nor holding null or non-finite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda v: v != 0)


def index(points: DataFrame, path: str, *, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """Writes the shards' graphs of all usable vectors to path and reads them back (columns index_schema()).

    Rows without an id and vectors that are not usable() take no part; rows that repeat an id and its vector count once. Each distinct vector
    carries its k + 1 smallest ids. An empty table writes an empty index.
    """
    spark, kind = points.sparkSession, _kind(points, vector)
    scratch = Scratch(spark, "ann-index")
    clean = points.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    few = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    # the bound on the rank is applied before the shuffle, too, so copies of one vector are not gathered
    first = clean.dropDuplicates(["id", "vector"]).withColumn("_nth", few).filter(F.col("_nth") <= k + 1)
    vertices = first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vertices = scratch.write(vertices.withColumns({"dim": F.size("vector"), "spot": F.xxhash64("vector")}), "vertices")
    shards = max(SHARDS, -(-vertices.count() // SHARD_ROWS))
    dealt = vertices.withColumn("shard", F.pmod("spot", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    dealt.groupBy("dim", "shard").applyInPandas(_build_shard, index_schema(kind)).write.mode("overwrite").parquet(path)
    scratch.drop()
    return spark.read.schema(index_schema(kind)).parquet(path)


class _Shard:
    """A shard's rows as arrays."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        column = lambda name: table.column(name).combine_chunks()
        n = table.num_rows
        self.vectors = column("vector").flatten().to_numpy().reshape(n, -1)
        self.ids = column("ids").to_pylist()
        level = column("level").to_numpy()
        flat, at = column("links").flatten().to_numpy().astype(np.int64), column("links").offsets.to_numpy().astype(np.int64)
        at = at[:-1] - at[0]
        layers = [flat[at[:, None] + np.arange(2 * LINKS)]]
        for k in range(1, int(level.max()) + 1):
            layers.append(flat[at[level >= k][:, None] + (k + 1) * LINKS + np.arange(LINKS)])
        self.graph = Graph(equally_long(self.vectors), layers)
        self.exact = self.vectors.astype(np.float64)


def _search_shards(k: int, width: int):
    """A function for mapInArrow: batches sorted by (dim, shard, kind, slot) hold a shard's rows (kind 0), then its queries (kind 1)."""

    def results(shard: _Shard, names: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        step = max(16, min(TOGETHER, 32_000_000 // len(shard.vectors)))
        for at in range(0, len(names), step):
            some = vectors[at : at + step]
            _, found = shard.graph.search(_unit(some), width)
            exact = np.einsum("qed,qd->qe", shard.exact[np.maximum(found, 0)], some.astype(np.float64))
            exact[found < 0] = -np.inf
            order = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1].tolist()
            for i, q in enumerate(names[at : at + step].tolist()):
                rows = [(-exact[i, j], v) for j in order[i] if found[i, j] >= 0 for v in shard.ids[found[i, j]] if v != q]
                rows = sorted(rows)[:k]
                out[0].extend([q] * len(rows))
                out[1].extend(v for _, v in rows)
                out[2].extend(-s for s, _ in rows)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        shard, place = None, None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            where = batch.column("dim").to_numpy().astype(np.int64) << 32 | batch.column("shard").to_numpy()
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (where[1:] != where[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kind)], strict=True):
                if a == b:
                    continue
                if where[a] != place:
                    parts, shard, place = [], None, where[a]
                if kind[a] == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if shard is None and parts:
                    shard, parts = _Shard(parts), []
                if shard is not None:
                    some = batch.slice(a, b - a)
                    yield results(shard, some.column("slot").to_numpy(), some.column("vector").flatten().to_numpy().reshape(b - a, -1))

    return search


def search(indexed: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k nearest of the index, other than its own id, ties to the smaller id.

    Queries without an id and vectors that are not usable() give no rows; fewer rows than k come if the index holds fewer.
    A query that is repeated with one vector counts once.
    """
    asked = queries.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("slot"), F.col(vector).cast(indexed.schema["vector"].dataType).alias("vector"))
    asked = asked.dropDuplicates(["slot", "vector"]).withColumn("dim", F.size("vector"))
    shards = indexed.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = indexed.select("dim", "shard", F.lit(0).alias("kind"), F.col("slot").cast("long").alias("slot"), "vector", "ids", "level", "links")
    both = both.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "kind", "slot")
    found = both.mapInArrow(_search_shards(k, width), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
