"""Region algebra on random boxes, compared cell by cell."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesseral.functions.boxes import box_of_text, gcd, id_text
from tesseral.model import Identifier, Span
from tesseral.operators import region
from tesseral.operators.decorate import decorate, get_value_rows
from tesseral.operators.join import overlap_join, prefixed
from tesseral.queries import voxels


def some(seed: int, n: int = 6, z: int = 2) -> list[Identifier]:
    r = random.Random(seed)
    span = lambda lo, hi: Span(*sorted((r.randint(lo, hi), r.randint(lo, hi))))
    return [Identifier.new(z, span(-(2**z), 2**z - 1), span(0, 2**z - 1), span(0, 2**z - 1)) for _ in range(n)]


def cells(df, z: int = 2) -> set:
    return {tuple(r) for r in voxels(df, z).collect()}


def volume(df, z: int = 2) -> float:
    size = F.lit(1.0)
    for d in "fxy":
        size = size * (F.col(f"{d}_hi") - F.col(f"{d}_lo")) / F.lit(2.0 ** (31 - z))
    return df.agg(F.sum(size)).first()[0]


def everything(z: int = 2) -> set:
    n = 2**z
    return {(f, x, y) for f in range(-n, n) for x in range(n) for y in range(n)}


@pytest.fixture(scope="module", params=[1])
def two(request, spark):
    return region.literal(spark, some(request.param)), region.literal(spark, some(request.param + 50, 4))


def test_set_operations(two):
    a, b = two
    ca, cb = cells(a), cells(b)
    assert cells(region.intersection(a, b)) == ca & cb
    assert cells(region.union(a, b)) == ca | cb
    assert cells(region.difference(a, b)) == ca - cb
    assert cells(region.symmetric_difference(a, b)) == ca ^ cb
    assert cells(region.complement(a)) == everything() - ca
    assert region.equal(region.union(a, b), b.unionByName(a))
    assert region.equal(a, b) == (ca == cb)


def test_repeats_do_not_multiply_an_intersection(spark, two):
    """Regions with each box a hundred times: as many pairs as without repeats, and the same cells."""
    once = region.intersection(*two)
    many = region.intersection(*[r.crossJoin(spark.range(100)).drop("id") for r in two])
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect())) and once.count() > 0
    assert cells(many) == cells(two[0]) & cells(two[1])


def test_disjoint(two):
    whole = region.disjoint(two[0])
    assert volume(whole) == len(cells(two[0])) == len(cells(whole))


def test_many_boxes_meet_a_piece(spark, monkeypatch):
    monkeypatch.setattr(region, "FOLD", 3)
    a = region.literal(spark, some(9, 7))
    assert cells(region.complement(a)) == everything() - cells(a)
    assert volume(region.disjoint(a)) == len(cells(a))


@pytest.mark.parametrize("z", [8, 31])
def test_many_times_in_a_cell(spark, monkeypatch, z):
    monkeypatch.setattr(region, "FOLD", 3)
    r = random.Random(z)
    at = lambda a, b: Identifier.new(z, Span(3, 3), Span(5, 5), Span(6, 6), 60, Span(a, b))
    spans = [sorted((r.randint(0, 90), r.randint(0, 90))) for _ in range(12)]
    covered = {m for a, b in spans for m in range(a, b + 1)}
    many, cell = region.literal(spark, [at(a, b) for a, b in spans]), region.literal(spark, [at(0, 99)])
    minutes = lambda df: sorted(m for i in df.collect() for m in range(i["t_lo"] // 60, i["t_hi"] // 60))
    assert minutes(region.difference(cell, many)) == sorted(set(range(100)) - covered)
    assert minutes(region.disjoint(many)) == sorted(covered)
    left = region.difference(region.literal(spark, [Identifier.new(z, Span(3, 3), Span(5, 5), Span(6, 6))]), many).collect()
    assert all(i["i"] and i["t_lo"] % i["i"] == 0 for i in left)
    assert sorted(m for i in left for m in range(i["t_lo"] // 60, min(i["t_hi"] // 60, 100))) == sorted(set(range(100)) - covered)


def test_empty(spark):
    a, none = region.literal(spark, some(3)), region.empty(spark)
    assert region.intersection(a, none).isEmpty()
    assert cells(region.union(a, none)) == cells(region.difference(a, none)) == cells(region.symmetric_difference(a, none)) == cells(a)
    assert region.symmetric_difference(a, a).isEmpty()
    assert cells(region.complement(none)) == everything()


def test_time_and_space_mix(spark):
    here = Identifier.new(2, Span(0, 0), Span(1, 1), Span(1, 1))
    then = Identifier.new(2, Span(0, 0), Span(1, 1), Span(1, 1), 60, Span(10, 19))
    both = region.intersection(region.literal(spark, [here]), region.literal(spark, [then]))
    assert [r[0] for r in both.select(id_text()).collect()] == ["2/0/1/1_60/10:19"]
    rest = region.difference(region.literal(spark, [here]), region.literal(spark, [then]))
    assert sorted(r[0] for r in rest.select(id_text()).collect()) == ["2/0/1/1_60/0:9", "2/0/1/1_60/20:-"]


def test_to_pure_and_coalesce(spark):
    a = region.literal(spark, [Identifier.new(2, Span(0, 1), Span(1, 2), Span(0, 0))])
    pure = region.to_pure(a)
    assert pure.count() == 4
    assert region.coalesce(pure).select(*a.columns).collect() == a.collect()
    twice = region.literal(spark, [Identifier.new(2, Span(0, 0), Span(0, 2), Span(1, 1)), Identifier.new(2, Span(0, 0), Span(1, 3), Span(1, 1))])
    assert [r[0] for r in region.coalesce(twice).select(id_text()).collect()] == ["2/0/-/1_0/-"]


def test_join_meets_once_and_plans_no_loop(spark):
    a, b = prefixed(region.literal(spark, some(4, 20, 4)), "a_"), prefixed(region.literal(spark, some(5, 20, 3) + [Identifier.new(0, Span(), Span(), Span())]), "b_")
    pairs = overlap_join(a, b)
    from tesseral.functions.boxes import overlaps

    assert pairs.count() == pairs.distinct().count() == a.crossJoin(b).filter(overlaps("a_", "b_")).count()
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [0, 10**6])
def test_join_in_time(spark, monkeypatch, few):
    """Boxes of all sizes in space and time, open ones too, shuffled or broadcast."""
    from tesseral.functions.boxes import overlaps
    from tesseral.operators import join

    monkeypatch.setattr(join, "FEW", few)
    r = random.Random(2)

    def box() -> Identifier:
        z, i = r.choice([0, 2, 8, 31]), r.choice([0, 1, 60, 86400])
        cell = lambda d: Span(*sorted(r.randrange(min(2**z, 5)) for _ in range(2)))
        lo = r.randrange(4)
        t = Span() if i == 0 else r.choice([Span(lo, lo), Span(lo, lo + 9), Span(lo, None), Span(None, lo), Span(lo * 1000, lo * 1000 + 500)])
        return Identifier.new(z, cell("f"), cell("x"), cell("y"), i, t)

    a, b = (prefixed(region.literal(spark, [box() for _ in range(60)]), p) for p in ("a_", "b_"))
    pairs, want = overlap_join(a, b), a.crossJoin(b).filter(overlaps("a_", "b_"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_a_box_is_listed_once_where_sizes_are_near(spark, sf_dir, monkeypatch):
    """Line items meet orders of one to eight cells on one grid, not on one for each size: few rows are shuffled, and no pair is lost."""
    from tesseral.functions.boxes import overlaps
    from tesseral.operators import join
    from tesseral.sources import layers

    monkeypatch.setattr(join, "FEW", 0)
    made, listed = [], join._listed
    monkeypatch.setattr(join, "_listed", lambda *args: made.append(listed(*args)) or made[-1])
    a, b = prefixed(layers.lineitem(spark, sf_dir), "a_"), prefixed(layers.orders(spark, sf_dir), "b_").filter("b_o_orderkey % 3 = 0")
    pairs = overlap_join(a, b)
    assert made[0].count() < 1.2 * a.count() and made[1].count() < 3.5 * b.count()
    key = lambda df: sorted(map(tuple, df.select("a_l_orderkey", "a_l_linenumber", "a_x_lo", "a_t_lo", "b_o_orderkey").collect()))
    assert key(pairs) == key(a.crossJoin(b).filter(overlaps("a_", "b_")))


@pytest.mark.parametrize("more", [1, 10**40])
def test_join_on_rounded_levels(spark, monkeypatch, more):
    """Levels kept, or all rounded up to one, give the same pairs, unbounded boxes and heights below zero included."""
    from tesseral.functions.boxes import overlaps
    from tesseral.operators import join

    monkeypatch.setattr(join, "FEW", 0)
    monkeypatch.setattr(join, "MORE", more)
    a = region.literal(spark, [*some(11, 20, 4), *some(12, 20, 6), Identifier.new(31, Span(-1, -1), Span(7, 7), Span(8, 8), 1, Span(5, 5))])
    b = region.literal(spark, [*some(13, 20, 3), Identifier.new(0, Span(), Span(), Span()), Identifier.new(31, Span(-9, 9), Span(0, 7), Span(8, 9), 60, Span(0, 3))])
    a, b = prefixed(a, "a_"), prefixed(b, "b_")
    want = a.crossJoin(b).filter(overlaps("a_", "b_"))
    assert sorted(map(tuple, overlap_join(a, b).collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def test_parts_are_named(spark):
    """Every part of a cut box has a text that names it, at the finest resolution of what cut it."""
    row = region.literal(spark, [Identifier.new(2, Span(0, 0), Span(1, 1), Span(1, 1))]).withColumn("v", F.lit(7))
    cut = region.literal(spark, [Identifier.new(3, Span(0, 0), Span(2, 2), Span(2, 2), 60, Span(5, 5))])
    parts = region.outside(row.unionByName(row.withColumn("v", F.lit(8))), cut).withColumn("id", id_text())
    for r in parts.collect():
        assert Identifier.from_box(r.asDict()).box() == tuple(r[c] for c in region.REGION) and r["z"] == 3
    read = parts.select("v", box_of_text(F.col("id")).alias("b"), F.struct(*region.REGION).alias("w"))
    assert read.filter("b = w").count() == read.count() and read.groupBy("v").count().count() == 2
    whole = region.outside(row, region.literal(spark, [Identifier.new(3, Span(1, 1), Span(7, 7), Span(2, 2))]))
    assert whole.collect() == row.select(*whole.columns).collect()


def test_texts_are_read(spark):
    texts = ["4/5/3/10_60/100", "2/-1:0/-/1:-_0/-", "3/-:2/-:4/7_30/2:-", "0/-/-/-_0/-", "31/-5:-/0/9_1/-:8"]
    ids = [Identifier.new(4, Span(5, 5), Span(3, 3), Span(10, 10), 60, Span(100, 100)), Identifier.new(2, Span(-1, 0), Span(), Span(1, None)), Identifier.new(3, Span(None, 2), Span(None, 4), Span(7, 7), 30, Span(2, None)), Identifier.new(0, Span(), Span(), Span()), Identifier.new(31, Span(-5, None), Span(0, 0), Span(9, 9), 1, Span(None, 8))]
    rows = spark.createDataFrame([(t,) for t in [*texts, "no text", None]], "t string").select(box_of_text(F.col("t")).alias("b")).collect()
    assert [tuple(r["b"]) for r in rows[:5]] == [i.box() for i in ids]
    assert rows[5]["b"]["x_lo"] is None


def test_cells_are_bounded(spark):
    a = region.literal(spark, [Identifier.new(20, Span(0, 0), Span(), Span(3, 3))])
    assert region.to_pure(a).count() == 2**20
    with pytest.raises(Exception, match="1048576 cells is not listed"):
        region.to_pure(a, most=1000).collect()


def test_coalesce_to_the_end(spark):
    """A box that only merges along y once its parts have merged along x, and so on, in an order of axes that takes several passes."""
    ids = [Identifier.new(3, Span(0, 0), Span(x, x), Span(0, 0)) for x in range(4)] + [Identifier.new(3, Span(0, 0), Span(0, 3), Span(1, 1)), Identifier.new(3, Span(1, 1), Span(0, 3), Span(0, 1))]
    assert [r[0] for r in region.coalesce(region.literal(spark, ids * 2), None, "fyx").select(id_text()).collect()] == ["3/0:1/-:3/-:1_0/-"]


def test_gcd_and_coordinates(spark):
    row = spark.range(1).select(gcd(F.lit(84), F.lit(36)), gcd(F.lit(0), F.lit(5)), gcd(F.lit(7), F.lit(0))).first()
    assert tuple(row) == (12, 5, 7)
    shown = decorate(region.literal(spark, [Identifier.new(0, Span(), Span(), Span())]), vertex=True, center=True, id_string=True).first()
    assert shown["id_string"] == "0/-/-/-_0/-"
    assert {round(v["longitude"]) for v in shown["vertex"]} == {-180, 180}
    assert len({tuple(v) for v in shown["vertex"]}) == 8
    assert get_value_rows(region.literal(spark, some(1, 1)), id_pure=True, id_string=True).count() == len(cells(region.literal(spark, some(1, 1))))
