"""Overlap join of boxes on four axes, as an equi-join on grid cells of x, y and time.

Each box has two levels: in space, the least power of two that its longer side of x and y does not exceed, and in time, that of its
duration. On the grids of these levels it covers at most two cells per axis. A pair meets in the coarser of its two levels, of space
and of time apart: a box is listed once for each such meeting level that the other side's levels (a few pairs of numbers, which are
read first) make with its own. Of the cells that both have there, the one of the intersection's lower corner makes the pair, so every pair
comes once. The height, and the exact bounds, are a residual condition. There is no nested loop, and boxes of any size, unbounded
ones too, take part. A side that has few boxes, by the count that comes with its levels, is broadcast. Where both sides are shuffled,
levels are first rounded up to fewer ones, as far as the pairs to compare stay in bounds, so that a box is listed less often.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions.boxes import overlaps

#: Most boxes of a side that is sent to every executor.
FEW = 20_000
#: How many times as many pairs, by the levels' counts, may be compared when levels are rounded up.
MORE = 2
#: Axes with cells in the key, and which of the two levels they have.
_GRID = {"x": "space", "y": "space", "t": "time"}


def _bits(side: Column) -> Column:
    return F.length(F.bin(side - 1)).cast("int") - (side <= 1).cast("int")


def _levels(prefix: str) -> dict[str, Column]:
    side = {d: F.col(f"{prefix}{d}_hi") - F.col(f"{prefix}{d}_lo") for d in _GRID}
    return {"space": _bits(F.greatest(side["x"], side["y"])), "time": _bits(side["t"])}


def _solid(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(" and ".join(f"`{prefix}{d}_lo` < `{prefix}{d}_hi`" for d in _GRID))


def shapes(df: DataFrame, prefix: str) -> list[tuple[int, int, int]]:
    """(level of space, level of time, number of boxes) of the pairs of levels that df's boxes have."""
    df = _solid(df, prefix)
    return [tuple(r) for r in df.groupBy(*[c.alias(k) for k, c in _levels(prefix).items()]).count().collect()]


def _rounded(shape: list[tuple[int, int, int]], grids: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
    """The shape with levels rounded up to those of the grids."""
    out: Counter = Counter()
    for *levels, n in shape:
        out[tuple(min(g for g in grid if g >= v) for v, grid in zip(levels, grids, strict=True))] += n
    return [(*levels, n) for levels, n in out.items()]


def _compared(one: list[tuple[int, int, int]], two: list[tuple[int, int, int]]) -> int:
    """In proportion to the pairs in the same cells, if boxes lie anywhere: a cell of space has two sides, one of time has one."""
    return sum(n * m << 2 * max(s, v) + max(t, w) for s, t, n in one for v, w, m in two)


def _grids(one: list[tuple[int, int, int]], two: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The levels of space and of time to keep: from the finest on, each is dropped for the next one if that is no more than MORE allows."""
    most = MORE * _compared(one, two)
    kept = tuple(sorted({v[k] for v in [*one, *two]}) for k in range(2))
    for k in range(2):
        for level in kept[k][:-1]:
            fewer = tuple([g for g in grid if i != k or g != level] for i, grid in enumerate(kept))
            if _compared(_rounded(one, fewer), _rounded(two, fewer)) <= most:
                kept = fewer
    return kept


def _listed(df: DataFrame, prefix: str, others: list[tuple[int, int, int]], names: str, grids: tuple[list[int], list[int]] | None) -> DataFrame:
    """The boxes with a row for each cell, columns named by ``names``, that they are listed under; with grids, levels are rounded up to theirs."""
    levels = _levels(prefix)
    if grids:
        levels = {k: F.coalesce(*[F.when(c <= g, F.lit(g)) for g in grid]) for (k, c), grid in zip(levels.items(), grids, strict=True)}
    df = df.withColumns({f"{prefix}{k}": c for k, c in levels.items()})
    each = F.array(*[F.struct(F.lit(s).alias("space"), F.lit(t).alias("time")) for s, t, _ in others]) if others else F.array().cast("array<struct<space:int,time:int>>")
    coarser = F.transform(each, lambda v: F.struct(*[F.greatest(v[k], F.col(f"{prefix}{k}")).alias(k) for k in ("space", "time")]))
    df = df.withColumn("_level", F.explode(F.array_distinct(coarser))).withColumns({f"{names}{k}": F.col(f"_level.{k}") for k in ("space", "time")}).drop("_level")
    for d, k in _GRID.items():
        cells = F.expr(f"sequence(shiftright(`{prefix}{d}_lo`, {names}{k}), shiftright(`{prefix}{d}_hi` - 1, {names}{k}))")
        df = df.withColumn(f"{names}c{d}", F.explode(cells))
    return df


def overlap_join(left: DataFrame, right: DataFrame, a: str = "a_", b: str = "b_", on: Column | None = None, left_shapes: list | None = None, right_shapes: list | None = None) -> DataFrame:
    """Pairs of overlapping boxes; the columns of the two sides have the prefixes a and b already. ``on`` is one more condition. The
    shapes of a side, or of a table that holds it, can be given if they are known.

    Null bounds meet nothing; repeated boxes pair as often as they come. An empty side gives no pairs.
    """
    if not left.columns or not right.columns:
        raise ValueError("no columns")
    left, right = _solid(left, a), _solid(right, b)
    mine = shapes(left, a) if left_shapes is None else left_shapes
    other = shapes(right, b) if right_shapes is None else right_shapes
    few = [sum(n for _, _, n in s) for s in (mine, other)]
    grids = _grids(mine, other) if min(few) > FEW else None
    if grids:
        mine, other = _rounded(mine, grids), _rounded(other, grids)
    one, two = _listed(left, a, other, "_l_", grids), _listed(right, b, mine, "_r_", grids)
    condition = overlaps(a, b)
    for k in ("space", "time"):
        condition = condition & (F.col(f"_l_{k}") == F.col(f"_r_{k}")) & (F.col(f"_l_{k}") == F.greatest(F.col(f"{a}{k}"), F.col(f"{b}{k}")))
    for d, k in _GRID.items():
        condition = condition & (F.col(f"_l_c{d}") == F.col(f"_r_c{d}"))
        condition = condition & (F.col(f"_l_c{d}") == F.expr(f"shiftright(greatest(`{a}{d}_lo`, `{b}{d}_lo`), _l_{k})"))
    if min(few) <= FEW:
        one, two = (F.broadcast(one), two) if few[0] <= few[1] else (one, F.broadcast(two))
    pairs = one.join(two, condition if on is None else condition & on)
    return pairs.select(*[F.col(c) for c in [*left.columns, *right.columns]])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})
