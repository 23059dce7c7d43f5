"""Longitude, latitude and altitude of boxes (Web Mercator tiles; the height axis is 2**25 metres per 2**z steps)."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the finest grid.
N = float(2**31)
METRES = float(2**25)


def longitude(x: Column) -> Column:
    return F.lit(360.0) * (x / F.lit(N)) - F.lit(180.0)


def latitude(y: Column) -> Column:
    """Falls as y rises."""
    e = (F.lit(1.0) - F.lit(2.0) * y / F.lit(N)) * F.lit(pi)
    return F.degrees(F.lit(2.0) * F.atan(F.lit(1.0) - F.lit(2.0) / (F.exp(e) + F.lit(1.0))))


def altitude(f: Column) -> Column:
    return F.lit(METRES) * (f / F.lit(N))


def extent(prefix: str = "") -> dict[str, tuple[Column, Column]]:
    """First and second latitude, longitude and altitude of a box."""
    ways = {"latitude": (latitude, "y"), "longitude": (longitude, "x"), "altitude": (altitude, "f")}
    return {k: tuple(g(F.col(f"{prefix}{a}_{e}")) for e in ("lo", "hi")) for k, (g, a) in ways.items()}


def point(latitude: Column, longitude: Column, altitude: Column) -> Column:
    return F.struct(latitude.alias("latitude"), longitude.alias("longitude"), altitude.alias("altitude"))


def center(prefix: str = "") -> Column:
    """Midpoints of the three extents, in degrees and metres."""
    return point(*[(a + b) / 2 for a, b in extent(prefix).values()])


def vertices(prefix: str = "") -> Column:
    """The eight corners: by latitude, then longitude, then altitude."""
    e = extent(prefix)
    return F.array(*[point(la, lo, al) for la in e["latitude"] for lo in e["longitude"] for al in e["altitude"]])
