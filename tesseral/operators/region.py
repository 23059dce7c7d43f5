"""Set algebra of regions: DataFrames with the columns z, i and the eight bounds of a box.

A region is the union of its boxes. Operators that must not count a cell twice first make the boxes disjoint. Differences
fold the boxes that meet a piece into the piece; a piece that more than FOLD boxes meet is split first, in space or in
time, again and again, so no task holds an unbounded list and the universe is tiled only where a complement needs it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesseral.functions.boxes import box_struct, clipped, coarsest_i, coarsest_z, contains, gcd, minus, shared_resolution, steps
from tesseral.model import AXES, BOX, FINEST, FOREVER, SCHEMA, Identifier
from tesseral.operators.join import overlap_join, prefixed, shapes
from tesseral.shared import written

REGION = ["z", "i", *BOX]
#: Boxes that are folded into one piece.
FOLD = 64
#: Cells that to_pure lists of one box.
MOST_CELLS = 1 << 24
_INSIDE = ["_space", *[f"_in_{d}" for d in AXES], "_middle"]


def literal(spark: SparkSession, ids: list[Identifier]) -> DataFrame:
    """The identifiers as a region, each once."""
    return spark.createDataFrame([i.box() for i in dict.fromkeys(ids)], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def universe(spark: SparkSession) -> DataFrame:
    """Everything: one box."""
    edge = 2**FINEST
    bounds = {"f": (-edge, edge), "x": (0, edge), "y": (0, edge), "t": (0, FOREVER)}
    return spark.createDataFrame([(0, 0, *[v for a in AXES for v in bounds[a]])], SCHEMA)


def _distinct(df: DataFrame) -> DataFrame:
    """One row per box, at the finest resolution that it came with."""
    return df.groupBy(*BOX).agg(F.max("z").alias("z"), F.min("i").alias("i")).select(*REGION)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clipped boxes of all overlapping pairs of different boxes: repeats go first, as n copies of a box by m of another make n * m pairs."""
    a, b = (written(_distinct(df.select(*REGION)), "side") for df in (a, b))
    pairs = overlap_join(prefixed(a, "a_"), prefixed(b, "b_"))
    return pairs.select(*shared_resolution("a_", "b_"), *clipped("a_", "b_"))


def _bounds_inside() -> list:
    """Of the boxes b_ that meet a piece a_: how many have a bound inside it along f, x and y together (_space), along each of these, and
    along t, and a middle one of the bounds along t. A box without a bound inside covers the piece."""
    inside = {d: (F.col(f"b_{d}_lo") > F.col(f"a_{d}_lo")) | (F.col(f"b_{d}_hi") < F.col(f"a_{d}_hi")) for d in AXES}
    at = F.when(F.col("b_t_lo") > F.col("a_t_lo"), F.col("b_t_lo")).when(F.col("b_t_hi") < F.col("a_t_hi"), F.col("b_t_hi"))
    each = [F.count_if(inside[d]).alias(f"_in_{d}") for d in AXES]
    return [F.count_if(inside["f"] | inside["x"] | inside["y"]).alias("_space"), *each, F.percentile_approx(at, 0.5).alias("_middle")]


def _halves(df: DataFrame) -> DataFrame:
    """Each box cut where boxes that meet it have bounds: in space, at the coarsest grid line along each axis with a bound inside, or in
    time, at the middle bound, if more boxes have one there. Every part has fewer bounds inside, or is shorter, than the box."""
    df = df.withColumn("_time", F.col("_in_t") > F.col("_space"))
    pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    for d in AXES:
        lo, hi = f"{d}_lo", f"{d}_hi"
        if d == "t":
            cut, line = F.col("_time"), F.col("_middle")
        else:
            bit = F.floor(F.log2(F.expr(f"cast({lo} ^ ({hi} - 1) as double)"))).cast("int")
            cut, line = ~F.col("_time") & (F.col(f"_in_{d}") > 0), F.when((F.col(lo) < 0) & (F.col(hi) > 0), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", F.col(hi) - 1, bit), bit))
        halves = F.when(cut, F.array(pair(F.col(lo), line), pair(line, F.col(hi)))).otherwise(F.array(pair(F.col(lo), F.col(hi))))
        df = df.withColumn("_h", F.explode(halves)).withColumns({lo: F.col("_h.lo"), hi: F.col("_h.hi")}).drop("_h")
    step = F.when(F.col("_time"), gcd(F.col("i"), F.col("_middle"))).otherwise(F.col("i"))
    return df.withColumns({"z": F.greatest("z", coarsest_z()), "i": step}).select("_of", *REGION)


def _subtract(a: DataFrame, b: DataFrame, earlier: bool) -> DataFrame:
    """The parts of a's boxes outside b, with the box they are of (_of); with ``earlier`` only boxes that come before a's in the order
    of bounds are taken away.

    a has one row per box. A piece's resolution is the finest
    of the boxes that cut it. A heavy piece that no box covers has a bound inside, and splitting leaves fewer, so the rounds end.
    """
    pieces = a.withColumn("_of", box_struct())
    b = prefixed(_distinct(b), "b_")
    cutters = shapes(b, "b_")
    done: list[DataFrame] = []
    while True:
        before = F.struct(*[f"b_{c}" for c in BOX]) < F.col("a__of") if earlier else None
        named = prefixed(pieces, "a_")
        mine = shapes(named, "a_")
        pairs = overlap_join(named, b, on=before, left_shapes=mine, right_shapes=cutters)
        key = [f"a_{c}" for c in ("_of", *BOX)]
        whole = F.max(contains("b_", "a_"))
        counted = written(pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), whole.alias("_gone"), *_bounds_inside()), "counted")
        met = written(named.join(counted, key, "left"), "met")
        done.append(met.filter("_n is null").select(*[F.col(f"a_{c}").alias(c) for c in ("_of", *REGION)]))
        folds = met.filter(F.col("_n").isNotNull() & ~F.col("_gone") & (F.col("_n") <= FOLD)).drop("_n", "_gone", *_INSIDE)
        lists = overlap_join(folds, b, on=before, left_shapes=mine, right_shapes=cutters).groupBy(*[f"a_{c}" for c in ("_of", *REGION)]).agg(F.collect_list(box_struct("b_")).alias("_bs"), F.max("b_z").alias("b_z"), F.collect_set("b_i").alias("_is"))
        finest = F.aggregate("_is", F.col("a_i"), gcd)
        parts = lists.select(F.col("a__of").alias("_of"), F.greatest("a_z", "b_z").alias("z"), finest.alias("i"), F.explode(minus(box_struct("a_"), F.col("_bs"))).alias("_p"))
        done.append(written(parts.select("_of", "z", "i", "_p.*"), "parts"))
        heavy = met.filter(F.col("_n").isNotNull() & ~F.col("_gone") & (F.col("_n") > FOLD))
        if heavy.isEmpty():
            break
        pieces = written(_halves(heavy.select(*[F.col(f"a_{c}").alias(c) for c in ("_of", *REGION)], *_INSIDE)), "pieces")
    return reduce(DataFrame.unionByName, done)


def disjoint(df: DataFrame) -> DataFrame:
    """The same region in boxes that share nothing."""
    each = written(_distinct(df.select(*REGION)), "distinct")
    return _subtract(each, each, earlier=True).select(*REGION)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Disjoint boxes of both."""
    return disjoint(a.select(*REGION).unionByName(b.select(*REGION)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without b; disjoint if a's boxes are."""
    return _subtract(written(_distinct(a.select(*REGION)), "minuend"), b.select(*REGION), earlier=False).select(*REGION)


def outside(rows: DataFrame, area: DataFrame) -> DataFrame:
    """The parts of rows' boxes outside a region, each with its row's other columns. A part is named at the finest resolution of its
    row and of the boxes that cut it, a whole box at its row's own."""
    parts = _subtract(written(_distinct(rows.select(*REGION)), "minuend"), area.select(*REGION), earlier=False)
    parts = parts.select(*[F.col(f"_of.{c}").alias(f"_of_{c}") for c in BOX], *[F.col(c).alias(f"_p_{c}") for c in REGION])
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_of_{c}") for c in BOX])
    uncut = reduce(Column.__and__, [F.col(f"_p_{c}") == F.col(f"_of_{c}") for c in BOX])
    resolution = {"z": F.when(uncut, F.col("z")).otherwise(F.greatest("z", "_p_z")), "i": F.when(uncut, F.col("i")).otherwise(gcd(F.col("i"), F.col("_p_i")))}
    bounds = {c: F.col(f"_p_{c}") for c in BOX}
    return rows.join(parts, same).select(*[(resolution | bounds).get(c, F.col(c)).alias(c) for c in rows.columns])


def complement(df: DataFrame) -> DataFrame:
    """Everything but the region; of the empty region, everything."""
    return difference(universe(df.sparkSession), df)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return disjoint(difference(a, b)).unionByName(disjoint(difference(b, a)))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether both cover the same cells, however they are cut."""
    return difference(a, b).isEmpty() and difference(b, a).isEmpty()


def _merged(df: DataFrame, d: str) -> DataFrame:
    """Boxes that touch or overlap along one axis and agree in all else, as one. Repeats go before the shuffle."""
    lo, hi = f"{d}_lo", f"{d}_hi"
    others = ["z", "i", *[c for c in BOX if c[0] != d]]
    df = df.groupBy(*others, lo).agg(F.max(hi).alias(hi))
    order = Window.partitionBy(*others).orderBy(lo)
    gap = F.col(lo) > F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int"))
    df = df.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*others, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).select(*REGION)


def coalesce(df: DataFrame, passes: int | None = 1, axes: str = "fxyt") -> DataFrame:
    """Merges boxes of one resolution that touch or overlap along one axis and agree in the others, axis by axis, so often, or
    with None until no two boxes are left that can be merged."""
    have, i = None, 0
    while passes is None or i < passes:
        df, i = reduce(_merged, axes, df), i + 1
        if passes is None:
            df = written(df, "merged")
            n = df.count()
            if n == have:
                break
            have = n
    return df


def coarsen(df: DataFrame) -> DataFrame:
    """Each box at the coarsest zoom and the longest step that present it exactly."""
    return df.withColumns({"z": coarsest_z(), "i": coarsest_i()}).select(*df.columns)


def change_scale(df: DataFrame, z: int | None = None, i: int | None = None) -> DataFrame:
    """The same boxes at a finer resolution; rows that are finer already raise an error when read."""
    out = df
    if z is not None:
        out = out.withColumn("z", F.when((F.col("z") <= z) & (F.lit(z) <= FINEST), F.lit(z)).otherwise(F.raise_error(F.lit(f"zoom {z} is not finer"))))
    if i is not None:
        fits = ((F.col("i") >= i) & (F.lit(i) > 0)) | ((F.col("i") == 0) & (F.lit(i) == 0))
        out = out.withColumn("i", F.when(fits, gcd(F.col("i"), F.lit(i))).otherwise(F.raise_error(F.lit(f"interval {i} is not finer"))))
    return out


def to_pure(df: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """Each box as its single cells of f, x and y at its own zoom; time stays as it is. Columns beyond the box are repeated. A box of
    more than ``most`` cells is an error when it is read, not a list that no executor can hold."""
    cells = F.lit(1.0)
    for d in "xyf":
        first, last = steps(d)
        cells = cells * (last - first + 1)
    df = df.withColumn("z", F.when(cells <= most, F.col("z")).otherwise(F.raise_error(F.concat(F.lit("a box of "), cells.cast("decimal(38,0)").cast("string"), F.lit(f" cells is not listed; the limit is {most}"))).cast("int")))
    for d in "xyf":
        first, last = steps(d)
        unit = F.expr(f"shiftleft(1L, {FINEST} - z)")
        df = df.withColumn("_s", F.explode(F.sequence(first, last))).withColumns({f"{d}_lo": F.col("_s") * unit, f"{d}_hi": (F.col("_s") + 1) * unit}).drop("_s")
    return df
