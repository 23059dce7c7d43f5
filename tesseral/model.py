"""One space-time identifier: zoom, four axis ranges and a time step, and its box on the finest grid.

An identifier of zoom z covers, on each of x, y and f (height), steps of a grid of 2**z cells, and on t steps of i seconds; i = 0
is all time. Its box has half-open integer bounds on the grid of zoom 31 and in seconds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import gcd

FINEST = 31
#: Upper bound of an open time range.
FOREVER = 2**63 - 1
AXES = ("f", "x", "y", "t")
BOX = [f"{a}_{e}" for a in AXES for e in ("lo", "hi")]
#: Box columns with the presentation resolution.
SCHEMA = "z int, i long, " + ", ".join(f"{c} long" for c in BOX)


@dataclass(frozen=True)
class Span:
    """A range of one axis: bounds inclusive, None where it is open."""

    lo: int | None = None
    hi: int | None = None

    def __str__(self) -> str:
        if self.lo is not None and self.lo == self.hi:
            return str(self.lo)
        if self.lo is None and self.hi is None:
            return "-"
        return ":".join("-" if v is None else str(v) for v in (self.lo, self.hi))

    @staticmethod
    def of(data: object) -> Span:
        """From its JSON form: "Any", or one of Single, LimitRange, BeforeUnLimitRange, AfterUnLimitRange."""
        if data == "Any":
            return Span()
        (kind, value), = data.items()  # type: ignore[union-attr]
        if kind == "Single":
            return Span(value, value)
        if kind == "LimitRange":
            return Span(*value)
        if kind == "BeforeUnLimitRange":
            return Span(None, value)
        if kind == "AfterUnLimitRange":
            return Span(value, None)
        raise ValueError(f"unknown variant `{kind}`")

    def json(self) -> object:
        if self.lo is None and self.hi is None:
            return "Any"
        if self.lo is None:
            return {"BeforeUnLimitRange": self.hi}
        if self.hi is None:
            return {"AfterUnLimitRange": self.lo}
        return {"Single": self.lo} if self.lo == self.hi else {"LimitRange": [self.lo, self.hi]}


def domain(axis: str, z: int) -> tuple[int, int]:
    """Least and largest step of f, x or y."""
    return (-(2**z), 2**z - 1) if axis == "f" else (0, 2**z - 1)


def _fitted(axis: str, span: Span, z: int) -> Span:
    """Swapped where reversed, checked, and open at the ends of the domain."""
    least, most = domain(axis, z)
    lo, hi = span.lo, span.hi
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    for v in (lo, hi):
        if v is not None and not least <= v <= most:
            raise ValueError(f"Invalid {axis} dimension: {v} is not in {least}..{most}")
    if lo is not None and lo == hi:
        return Span(lo, hi)
    lo, hi = (None if lo == least else lo), (None if hi == most else hi)
    if axis != "f" and lo == most:
        return Span(most, most)
    if axis != "f" and lo is None and hi == least:
        return Span(least, least)
    return Span(lo, hi)


@dataclass(frozen=True)
class Identifier:
    """A validated identifier; the text form is z/f/x/y_i/t."""

    z: int
    f: Span
    x: Span
    y: Span
    i: int
    t: Span

    @staticmethod
    def new(z: int, f: Span, x: Span, y: Span, i: int = 0, t: Span = Span()) -> Identifier:  # noqa: B008
        if z > FINEST or z < 0:
            raise ValueError(f"zoom {z} is not in 0..{FINEST}")
        f, x, y = (_fitted(a, s, z) for a, s in zip("fxy", (f, x, y), strict=True))
        if i == 0 and (t.lo is not None or t.hi is not None):
            raise ValueError("t must be Any when time interval i is 0.")
        if t.lo is not None and t.hi is not None and t.lo > t.hi:
            raise ValueError(f"start {t.lo} > end {t.hi}")
        return Identifier(z, f, x, y, i, t)

    @staticmethod
    def of(data: dict) -> Identifier:
        return Identifier.new(data["z"], *(Span.of(data[a]) for a in "fxy"), data["i"], Span.of(data["t"]))

    def __str__(self) -> str:
        return f"{self.z}/{self.f}/{self.x}/{self.y}_{self.i}/{self.t}"

    def json(self) -> dict:
        return {"z": self.z, **{a: getattr(self, a).json() for a in "fxy"}, "i": self.i, "t": self.t.json()}

    def box(self) -> tuple[int, ...]:
        """z, i and the bounds in the order of SCHEMA."""
        out: list[int] = [self.z, self.i]
        for a in "fxy":
            span, (least, most) = getattr(self, a), domain(a, self.z)
            lo, hi = (least if span.lo is None else span.lo), (most if span.hi is None else span.hi)
            out += [lo << (FINEST - self.z), (hi + 1) << (FINEST - self.z)]
        lo = 0 if self.t.lo is None else self.t.lo * self.i
        hi = FOREVER if self.t.hi is None else min(FOREVER, (self.t.hi + 1) * self.i)
        return (*out, lo, hi)

    @staticmethod
    def from_box(row: dict) -> Identifier:
        """The identifier of a box whose bounds are multiples of its resolution."""
        shift, z, i = FINEST - row["z"], row["z"], row["i"]
        spans = [Span(row[f"{a}_lo"] >> shift, (row[f"{a}_hi"] >> shift) - 1) for a in "fxy"]
        spans = [Span() if (s.lo, s.hi) == domain(a, z) else s for a, s in zip("fxy", spans, strict=True)]
        if i == 0 or (row["t_lo"] == 0 and row["t_hi"] >= FOREVER):
            t = Span()
        else:
            t = Span(row["t_lo"] // i, None if row["t_hi"] >= FOREVER else row["t_hi"] // i - 1)
        return Identifier.new(z, *spans, i, t)

    def change_scale(self, z: int | None = None, i: int | None = None) -> Identifier:
        """The same region at a finer zoom and a shorter step; a step that doesn't divide the present one gives their gcd."""
        z, i = self.z if z is None else z, self.i if i is None else i
        if z < self.z or z > FINEST:
            raise ValueError(f"zoom {z} must be from {self.z} to {FINEST}")
        if i > self.i or (i == 0) != (self.i == 0):
            raise ValueError(f"interval {i} must be from 1 to {self.i}")
        box = dict(zip(["z", "i", *BOX], self.box(), strict=True))
        return Identifier.from_box(box | {"z": z, "i": gcd(i, self.i)})

    def at(self, axis: str, span: Span) -> Identifier:
        return replace(self, **{axis: span})
