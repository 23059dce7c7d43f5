"""Queries over the driver's tables, each applying one operator (or one small combination) to whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral import __version__
from tesseral.engine import Engine, values_in, without
from tesseral.functions import boxes as B
from tesseral.functions import geo
from tesseral.functions.filters import predicate
from tesseral.model import BOX, FINEST, Identifier, Span
from tesseral.operators import region
from tesseral.operators.join import overlap_join, prefixed
from tesseral.plans.ranges import build
from tesseral.sources import layers

Query = Callable[[SparkSession, str], DataFrame]
#: Zoom of the two small regions.
Z = 5


def corridor(spark: SparkSession) -> DataFrame:
    """Two literal boxes: one over ten days, one for all time."""
    hour = lambda day: 1704067200 // 3600 + 24 * (day - 1)  # noqa: E731  of January 2024
    ids = [
        Identifier.new(4, Span(), Span(0, 5), Span(2, 8), 3600, Span(hour(5), hour(15) - 1)),
        Identifier.new(8, Span(-8, 39), Span(48, 143), Span(144, 255)),
    ]
    return region.literal(spark, ids).withColumn("cid", F.when(F.col("z") == 4, 0).otherwise(1))


def flagship_corridor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = layers.events(spark, sf_dir).filter(predicate("TEXT", "Equal", "error", F.col("event_type")))
    pairs = overlap_join(prefixed(events.drop("value"), "a_"), prefixed(corridor(spark), "b_"))
    return pairs.select(F.col("a_event_id").alias("event_id"), F.col("b_cid").alias("cid"), F.col("a_event_type").alias("event_type"), *B.clipped("a_", "b_"))


def id_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.events(spark, sf_dir).select("event_id", B.id_text().alias("id_string"))


def id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.orders(spark, sf_dir).select("o_orderkey", B.id_text().alias("id_string"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = geo.extent()
    columns = [F.round(c, 6).alias(f"{k}_{i}") for k, pair in e.items() for i, c in enumerate(pair)]
    return layers.events(spark, sf_dir).select("event_id", *columns)


def center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers.orders(spark, sf_dir).select("o_orderkey", geo.center().alias("c"))
    return rows.select("o_orderkey", *[F.round(F.col(f"c.{k}"), 6).alias(k) for k in ("latitude", "longitude", "altitude")])


def vertex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers.orders(spark, sf_dir).select("o_orderkey", F.posexplode(geo.vertices()).alias("corner", "p"))
    return rows.select("o_orderkey", "corner", *[F.round(F.col(f"p.{k}"), 6).alias(k) for k in ("latitude", "longitude", "altitude")])


def change_scale_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = region.change_scale(layers.orders(spark, sf_dir), z=10)
    return fine.select("o_orderkey", B.id_text().alias("id_string"))


def change_scale_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = region.change_scale(layers.orders(spark, sf_dir), i=21600)
    return fine.select("o_orderkey", B.id_text().alias("id_string"))


def coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.coarsen(layers.orders(spark, sf_dir)).select("o_orderkey", "z", "i")


def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = layers.sites(spark, sf_dir).distinct(), layers.zones(spark, sf_dir).distinct()
    pairs = overlap_join(prefixed(one, "a_"), prefixed(two, "b_"))
    return pairs.select(*[f"{p}_{d}_{e}" for p in "ab" for d in "fxy" for e in ("lo", "hi")], B.relation("a_", "b_").alias("relation"))


def voxels(df: DataFrame, z: int = Z) -> DataFrame:
    """Distinct cells (f, x, y) of a spatial region at one zoom."""
    for d in "fxy":
        df = df.withColumn(d, F.explode(F.expr(f"sequence(shiftright({d}_lo, {FINEST - z}), shiftright({d}_hi - 1, {FINEST - z}))")))
    return df.select("f", "x", "y").distinct()


def to_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = region.to_pure(layers.sites(spark, sf_dir))
    return cells.groupBy(*[F.expr(f"shiftright({d}_lo, {FINEST - Z})").alias(d) for d in "fxy"]).agg(F.count(F.lit(1)).alias("n"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return layers.sites(spark, sf_dir), layers.zones(spark, sf_dir)


def _algebra(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: voxels(operator(*_two(spark, sf_dir)))


def complement_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(region.complement(layers.sites(spark, sf_dir)))


def disjoint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the disjoint boxes, counted with repeats, against the cells themselves."""
    whole = region.disjoint(layers.sites(spark, sf_dir))
    size = F.lit(1)
    for d in "fxy":
        size = size * F.expr(f"shiftright({d}_hi - {d}_lo, {FINEST - Z})")
    return whole.agg(F.sum(size).cast("long").alias("cells"))


def region_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    rows = [("a = b", region.equal(a, b)), ("a | b = b | a", region.equal(region.union(a, b), b.unionByName(a))), ("a ^ a = nothing", region.equal(region.symmetric_difference(a, a), region.empty(spark)))]
    return spark.createDataFrame(rows, "what string, equal boolean")


def coalesce_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region.coalesce(layers.region_of(layers.lineitem(spark, sf_dir)), axes="t").select(*BOX)


def _lines(name: str, argument: object) -> Query:
    return lambda spark, sf_dir: layers.lineitem(spark, sf_dir).filter(predicate("INT", name, argument, F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "l_quantity", "x_lo", "y_lo", "t_lo")


def _orders(name: str, argument: str) -> Query:
    return lambda spark, sf_dir: layers.orders(spark, sf_dir).filter(predicate("TEXT", name, argument, F.col("o_orderpriority"))).select("o_orderkey", "o_orderpriority", "x_lo", "y_lo", "t_lo")


def _alarms(name: str, argument: bool | None) -> Query:
    return lambda spark, sf_dir: layers.events(spark, sf_dir).withColumn("alarm", F.col("event_type") == "error").filter(predicate("BOOLEAN", name, argument, F.col("alarm"))).select("event_id", "alarm", "x_lo", "y_lo", "t_lo")


def has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.region_of(layers.lineitem(spark, sf_dir)).distinct().select("z", "i", *BOX)


def _week(spark: SparkSession) -> DataFrame:
    """A literal region: half of the grid over 60 days of 1996."""
    return region.literal(spark, [Identifier.new(2, Span(-1, 0), Span(0, 1), Span(), 86400, Span(9500, 9559))])


def get_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values_in(layers.orders(spark, sf_dir), _week(spark))
    return rows.select("o_orderkey", "o_orderpriority", "z", "i", *BOX, B.id_text().alias("id_string"))


def get_value_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = region.to_pure(values_in(layers.orders(spark, sf_dir), _week(spark)))
    return rows.select("o_orderkey", *[F.expr(f"shiftright({d}_lo, 23)").alias(d) for d in "fxy"], "t_lo", "t_hi")


def put_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type whether a PutValue of it in the corridor would clash."""
    events = layers.events(spark, sf_dir)
    clash = overlap_join(prefixed(events, "a_"), prefixed(corridor(spark), "b_")).select(F.col("a_event_type").alias("event_type")).distinct()
    return events.select("event_type").distinct().join(clash.withColumn("conflict", F.lit(True)), "event_type", "left").select("event_type", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def set_value_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = region.literal(spark, [Identifier.new(3, Span(-1, 0), Span(2, 5), Span(1, 3)), Identifier.new(4, Span(1, 1), Span(), Span(3, 9))])
    return voxels(region.union(layers.sites(spark, sf_dir), area))


def _valued_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    one: Column = F.col("c_nationkey") + k % 3
    spans = {"f": (k % 6 - 1, k % 6), "x": (k % 29, k % 29), "y": (one, one)}
    return layers.boxes(layers.table(spark, sf_dir, "customer"), Z, 0, spans, (F.col("c_nationkey") % 5).cast("int").alias("v_int"))


def delete_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without(_valued_zones(spark, sf_dir), layers.sites(spark, sf_dir))
    cells = region.to_pure(left)
    return cells.select("v_int", *[F.expr(f"shiftright({d}_lo, {FINEST - Z})").alias(d) for d in "fxy"]).distinct()


def nested_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AND of A or a literal, not B, and XOR of A and a literal, across two spaces."""
    literal = {"SpaceTimeIdSet": [{"z": 2, "f": {"LimitRange": [-1, 0]}, "x": {"LimitRange": [0, 2]}, "y": "Any", "i": 0, "t": "Any"}]}
    has = lambda s: {"Function": {"HasValue": {"spacename": s, "keyname": "k"}}}
    tree = {"Prefix": {"AND": [{"Prefix": {"OR": [has("sites"), literal]}}, {"Prefix": {"NOT": [has("zones")]}}, {"Prefix": {"XOR": [has("sites"), literal]}}]}}
    found = {"sites": layers.sites, "zones": layers.zones}
    return voxels(build(spark, tree, lambda s, k, c: found[s](spark, sf_dir)))


def overlap_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items inside orders' boxes, per status of the order: a join of two large layers on four axes."""
    pairs = overlap_join(prefixed(layers.lineitem(spark, sf_dir), "a_"), prefixed(layers.orders(spark, sf_dir), "b_"))
    return pairs.groupBy(F.col("b_o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("a_l_quantity").alias("quantity"))


def _catalog(spark: SparkSession) -> Engine:
    engine = Engine(spark)
    for space, key, kind in (("events", "etype", "TEXT"), ("events", "alarm", "BOOLEAN"), ("events", "level", "FLOAT"), ("orders", "prio", "TEXT"), ("lineitem", "qty", "INT")):
        if space not in engine.spaces:
            engine.add_space(space)
        engine.add_key(space, key, kind)
    engine.add_space("scrap")
    engine.delete_space("scrap")
    return engine


def show_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(_catalog(spark).spaces)], "seq int, space string")


def show_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(_catalog(spark).keys("events"))], "seq int, key string")


def _store(spark: SparkSession, kind: str, rows: DataFrame, value: str) -> Engine:
    """An engine with one key, s/k, that holds the rows' values."""
    engine = Engine(spark)
    _run(engine, {"AddSpace": {"spacename": "s"}}, {"AddKey": AT | {"type": kind}})
    engine.load("s", "k", rows, value)
    return engine


def _run(engine: Engine, *commands: dict | str) -> list[dict]:
    """The results of one packet."""
    return json.loads(engine.execute(json.dumps({"command": list(commands)})))


AT = {"spacename": "s", "keyname": "k"}
SHOWN = {"vertex": False, "center": False, "id_string": True, "id_pure": False}


def _set(**axes: object) -> dict:
    return {"SpaceTimeIdSet": [{"f": "Any", "x": "Any", "y": "Any", "i": 0, "t": "Any"} | axes]}


def _everywhere(engine: Engine) -> DataFrame:
    """All values with the text of where they hold, and the box that the text names."""
    rows = engine.get_value("s", "k", _set(z=0), **SHOWN)
    return rows.select("v_int", "id_string", B.box_of_text(F.col("id_string")).alias("_b")).select("v_int", "id_string", "_b.*")


def _cells_of(df: DataFrame, z: int) -> DataFrame:
    for d in "fxy":
        df = df.withColumn(d, F.explode(F.expr(f"sequence(shiftright({d}_lo, {FINEST - z}), shiftright({d}_hi - 1, {FINEST - z}))")))
    return df.select("v_int", "f", "x", "y").distinct()


def command_set_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SetValue of 3 in a literal region, beside the zones' values; cells by value, read from the identifiers' texts."""
    engine = _store(spark, "INT", _valued_zones(spark, sf_dir), "v_int")
    area = {"Prefix": {"OR": [_set(z=3, f={"LimitRange": [-1, 0]}, x={"LimitRange": [2, 5]}, y={"LimitRange": [1, 3]}), _set(z=4, f={"Single": 1}, y={"LimitRange": [3, 9]})]}}
    assert _run(engine, {"SetValue": AT | {"range": area, "value": {"INT": 3}}}) == [{"Success": "Success"}]
    return _cells_of(_everywhere(engine), Z)


def command_put_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether PutValue of each number in a literal region clashes with the zones' values."""
    engine = _store(spark, "INT", _valued_zones(spark, sf_dir), "v_int")
    area = _set(z=3, f={"Single": 0}, x={"Single": 7}, y={"Single": 0})
    out = _run(engine, *[{"PutValue": AT | {"range": area, "value": {"INT": v}}} for v in range(6)])
    return spark.createDataFrame([(v, "Error" in r) for v, r in enumerate(out)], "v_int int, conflict boolean")


def command_delete_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DeleteValue of cells finer than the zones; what is left, read from the identifiers' texts."""
    engine = _store(spark, "INT", _valued_zones(spark, sf_dir), "v_int")
    area = _set(z=Z + 1, f={"Single": 1}, x={"LimitRange": [3, 40]}, y={"LimitRange": [5, 31]})
    assert _run(engine, {"DeleteValue": AT | {"range": area}}) == [{"Success": "Success"}]
    return _cells_of(_everywhere(engine), Z + 1)


def command_get_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON rows of GetValue in 60 days and half of the grid."""
    engine = _store(spark, "TEXT", layers.orders(spark, sf_dir), "o_orderpriority")
    area = _set(z=2, f={"LimitRange": [-1, 0]}, x={"LimitRange": [0, 1]}, i=86400, t={"LimitRange": [9500, 9559]})
    (out,) = _run(engine, {"GetValue": AT | {"range": area} | SHOWN})
    return spark.createDataFrame([(r["value"]["TEXT"], r["id_string"]) for r in out["Success"]["GetValue"]], "priority string, id_string string")


def command_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON rows of Select of the sites in a literal region, as cells."""
    engine = _store(spark, "INT", layers.sites(spark, sf_dir).withColumn("v", F.lit(1)), "v")
    tree = {"Prefix": {"AND": [{"Function": {"HasValue": AT}}, _set(z=2, f={"LimitRange": [-1, 0]}, x={"LimitRange": [0, 2]})]}}
    (out,) = _run(engine, {"Select": {"range": tree} | SHOWN})
    rows = [Identifier.of(r["spacetimeid"]).box() for r in out["Success"]["SelectValue"]]
    return voxels(spark.createDataFrame(rows, region.SCHEMA))


def command_delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(_catalog(spark), {"DeleteKey": {"spacename": "events", "name": "alarm"}}, {"DeleteKey": {"spacename": "events", "name": "alarm"}}, {"Keys": {"spacename": "events"}})
    return spark.createDataFrame([(i, k, "Error" in out[1]) for i, k in enumerate(out[2]["Success"]["KeyNames"])], "seq int, key string, twice_fails boolean")


def filter_value_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FilterValue as the engine looks it up: the region of the lines of 10 to 12 pieces."""
    engine = _store(spark, "INT", layers.lineitem(spark, sf_dir), "l_quantity")
    return engine.lookup("s", "k", {"FilterINT": {"Between": [10, 12]}}).select("z", "i", *BOX)


def version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(__version__,)], "version string")


def queries() -> dict[str, Query]:
    named = [flagship_corridor_errors, id_display, id_normalize, coordinates, center, vertex_rows, change_scale_z, change_scale_i, coarsen, containment_pairs, to_pure, complement_voxels, disjoint_cells, region_equal, coalesce_adjacent, has_value, get_value, get_value_pure, put_conflicts, set_value_union, delete_value, nested_prefix, overlap_join_lines, show_spaces, show_keys, version, command_set_value, command_put_value, command_delete_value, command_get_value, command_select, command_delete_key, filter_value_region]
    out: dict[str, Query] = {f.__name__: f for f in named}
    out |= {f"region_{k}_voxels": _algebra(f) for k, f in (("and", region.intersection), ("or", region.union), ("xor", region.symmetric_difference), ("diff", region.difference))}
    out["region_not_voxels"] = lambda spark, sf_dir: voxels(region.complement(region.union(*_two(spark, sf_dir))))
    out |= {f"filter_int_{n.lower()}": _lines(n, a) for n, a in INT.items()}
    out |= {f"filter_text_{n.lower()}": _orders(n, a) for n, a in TEXT.items()}
    out |= {f"filter_bool_{n.lower()}": _alarms(n, a) for n, a in BOOLEAN.items()}
    return out


#: Arguments of the predicate queries.
INT: dict[str, object] = {"Equal": 25, "NotEqual": 25, "GreaterThan": 45, "GreaterEqual": 45, "LessThan": 5, "LessEqual": 5, "Between": [10, 12], "In": [1, 7, 50], "NotIn": [1, 7, 50]}
TEXT = {"Equal": "1-URGENT", "NotEqual": "1-URGENT", "Contains": "-", "NotContains": "IG", "StartsWith": "5", "EndsWith": "H", "CaseInsensitiveEqual": "2-high"}
BOOLEAN = {"IsTrue": None, "IsFalse": None, "Equals": True, "NotEquals": True}
