"""Columns on boxes: overlap, clipping, difference, relation, resolution and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.model import AXES, BOX, FINEST, FOREVER


def _at(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def overlaps(a: str, b: str) -> Column:
    """Whether the boxes in the columns with the prefixes a and b share a cell."""
    out = F.lit(True)
    for d in AXES:
        out = out & (_at(a, f"{d}_lo") < _at(b, f"{d}_hi")) & (_at(b, f"{d}_lo") < _at(a, f"{d}_hi"))
    return out


def clipped(a: str, b: str) -> list[Column]:
    """The bounds of the intersection, under the names of BOX."""
    return [(F.greatest if c.endswith("lo") else F.least)(_at(a, c), _at(b, c)).alias(c) for c in BOX]


def contains(a: str, b: str) -> Column:
    """Whether a covers b."""
    out = F.lit(True)
    for d in AXES:
        out = out & (_at(a, f"{d}_lo") <= _at(b, f"{d}_lo")) & (_at(a, f"{d}_hi") >= _at(b, f"{d}_hi"))
    return out


def relation(a: str, b: str) -> Column:
    """Full if a covers b, None if they share nothing, else Partial."""
    return F.when(~overlaps(a, b), "None").when(contains(a, b), "Full").otherwise("Partial")


def box_struct(prefix: str = "") -> Column:
    return F.struct(*[_at(prefix, c).alias(c) for c in BOX])


def slabs(p: Column, b: Column) -> Column:
    """The parts of box p outside box b (structs), disjoint: along each axis below and above b, earlier axes clipped to b."""
    meets = F.lit(True)
    for d in AXES:
        meets = meets & (p[f"{d}_lo"] < b[f"{d}_hi"]) & (b[f"{d}_lo"] < p[f"{d}_hi"])
    inner = {c: (F.greatest if c.endswith("lo") else F.least)(p[c], b[c]) for c in BOX}
    parts = []
    for k, d in enumerate(AXES):
        fixed = {c: (inner[c] if c[0] in AXES[:k] else p[c]) for c in BOX}
        for side in ({f"{d}_hi": inner[f"{d}_lo"]}, {f"{d}_lo": inner[f"{d}_hi"]}):
            parts.append(F.struct(*[(fixed | side)[c].alias(c) for c in BOX]))
    solid = F.filter(F.array(*parts), lambda q: (q["f_lo"] < q["f_hi"]) & (q["x_lo"] < q["x_hi"]) & (q["y_lo"] < q["y_hi"]) & (q["t_lo"] < q["t_hi"]))
    return F.when(meets, solid).otherwise(F.array(p))


def minus(p: Column, others: Column) -> Column:
    """The parts of box p outside all boxes of an array."""
    return F.aggregate(others, F.array(p), lambda have, b: F.flatten(F.transform(have, lambda q: slabs(q, b))))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs, gcd(0, b) = b, by Euclid's steps (at most 93 for longs)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0)).alias("b")))
    return F.when(a == b, a).when(b == 0, a).when(a == 0, b).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"])


def shared_resolution(a: str, b: str) -> list[Column]:
    """z and i of the intersection: the finer zoom, and the gcd of the steps."""
    return [F.greatest(_at(a, "z"), _at(b, "z")).alias("z"), gcd(_at(a, "i"), _at(b, "i")).alias("i")]


def coarsest_z(prefix: str = "") -> Column:
    """The coarsest zoom at which all bounds of f, x and y are whole steps."""
    bits = F.lit(0).cast("long")
    for d in "fxy":
        bits = bits.bitwiseOR(_at(prefix, f"{d}_lo")).bitwiseOR(_at(prefix, f"{d}_hi"))
    low = bits.bitwiseAND(-bits)
    return F.greatest(F.lit(0), F.lit(FINEST) - F.log2(low.cast("double")).cast("int"))


def coarsest_i(prefix: str = "") -> Column:
    """The longest step at which the time bounds are whole steps; 0 is all time."""
    lo, hi = _at(prefix, "t_lo"), _at(prefix, "t_hi")
    return F.when((lo == 0) & (hi == FOREVER), F.lit(0).cast("long")).when(hi == FOREVER, lo).otherwise(gcd(lo, hi))


def span_text(lo: Column, hi: Column, least: Column, most: Column) -> Column:
    """Text of an inclusive range in a domain: a number, a:b, -:b, a:- or -."""
    return (
        F.when((lo <= least) & (hi >= most), "-")
        .when(lo == hi, lo.cast("string"))
        .when(lo <= least, F.concat(F.lit("-:"), hi.cast("string")))
        .when(hi >= most, F.concat(lo.cast("string"), F.lit(":-")))
        .otherwise(F.concat_ws(":", lo.cast("string"), hi.cast("string")))
    )


def steps(axis: str, prefix: str = "") -> tuple[Column, Column]:
    """First and last step of f, x or y at the box's own zoom."""
    first, last = (F.expr(f"shiftright(`{prefix}{axis}_{e}`, {FINEST} - `{prefix}z`)") for e in ("lo", "hi"))
    return first, last - 1


def id_text(prefix: str = "") -> Column:
    """z/f/x/y_i/t of a box whose bounds are multiples of its resolution."""
    z, i = _at(prefix, "z"), _at(prefix, "i")
    size = F.expr(f"shiftleft(1L, `{prefix}z`)")
    texts = {}
    for d in "fxy":
        lo, hi = steps(d, prefix)
        texts[d] = span_text(lo, hi, -size if d == "f" else F.lit(0), size - 1)
    t_lo, t_hi = _at(prefix, "t_lo"), _at(prefix, "t_hi")
    first, last = F.expr(f"`{prefix}t_lo` div nullif(`{prefix}i`, 0)"), F.expr(f"`{prefix}t_hi` div nullif(`{prefix}i`, 0)") - 1
    t = (
        F.when((i == 0) | ((t_lo == 0) & (t_hi == FOREVER)), "-")
        .when(t_hi == FOREVER, F.concat(first.cast("string"), F.lit(":-")))
        .when(first == last, first.cast("string"))
        .otherwise(F.concat_ws(":", first.cast("string"), last.cast("string")))
    )
    return F.concat(z.cast("string"), F.lit("/"), texts["f"], F.lit("/"), texts["x"], F.lit("/"), texts["y"], F.lit("_"), i.cast("string"), F.lit("/"), t)


def _parsed(text: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """First and last step of a range's text."""
    shape = r"^(-?\d+|-)(?::(-?\d+|-))?$"
    first, second = (F.regexp_extract(text, shape, k) for k in (1, 2))
    lo = F.when(first == "-", least).otherwise(first.try_cast("long"))
    hi = F.when((second == "-") | (text == "-"), most).when(second == "", lo).otherwise(second.try_cast("long"))
    return lo, hi


def box_of_text(text: Column) -> Column:
    """The box of an identifier's text, the inverse of id_text: a struct of z, i and the bounds; null bounds where the text is none."""
    part = lambda k: F.get(F.split(text, "/"), F.lit(k))
    y_i = F.split(part(3), "_")
    z, i = part(0).try_cast("int"), F.get(y_i, F.lit(1)).try_cast("long")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), z)
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(FINEST) - z)
    out = [z.alias("z"), i.alias("i")]
    for d, t in (("f", part(1)), ("x", part(2)), ("y", F.get(y_i, F.lit(0)))):
        lo, hi = _parsed(t, -size if d == "f" else F.lit(0).cast("long"), size - 1)
        out += [(lo * unit).alias(f"{d}_lo"), ((hi + 1) * unit).alias(f"{d}_hi")]
    lo, hi = _parsed(part(4), F.lit(0).cast("long"), F.lit(None).cast("long"))
    open_end = part(4).endswith("-")
    out += [(lo * i).alias("t_lo"), F.when(open_end, F.lit(FOREVER)).otherwise((hi + 1) * i).alias("t_hi")]
    return F.struct(*out)
