"""Region expressions: a tree of literals, value regions and AND / OR / NOT / XOR as one DataFrame.

The tree has the JSON form of the command interface. AND of a negation becomes a difference, so the universe is not built
for it; nested ANDs and ORs are one fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tesseral.errors import RANGE, parse_error
from tesseral.model import Identifier
from tesseral.operators import region

#: (space, key, filter or None) to the region of the values that fit.
Lookup = Callable[[str, str, dict | None], DataFrame]


def _negation(node: dict) -> list | None:
    prefix = node.get("Prefix")
    return prefix["NOT"] if prefix and "NOT" in prefix else None


def is_disjoint(node: dict) -> bool:
    """Whether build() gives boxes that share nothing: all but value regions do, and intersections of what does."""
    ((kind, body),) = node.items()
    if kind == "Function":
        return False
    if kind == "Prefix" and "AND" in body:
        return all(is_disjoint(p) for p in body["AND"] if _negation(p) is None)
    return True


def build(spark: SparkSession, node: dict, lookup: Lookup) -> DataFrame:
    """The region of an expression."""
    ((kind, body),) = node.items()
    if kind == "SpaceTimeIdSet":
        try:
            ids = [Identifier.of(i) for i in body]
        except ValueError as e:
            raise parse_error(str(e), RANGE) from e
        return region.disjoint(region.literal(spark, ids)) if len(ids) > 1 else region.literal(spark, ids)
    if kind == "Function":
        ((name, call),) = body.items()
        return lookup(call["spacename"], call["keyname"], call["filter"] if name == "FilterValue" else None)
    ((name, parts),) = body.items()
    if name == "AND":
        takes = [build(spark, p, lookup) for p in parts if _negation(p) is None]
        cuts = [build(spark, q, lookup) for p in parts for q in _negation(p) or []]
        if not parts:
            return region.empty(spark)
        if not takes:
            takes = [region.universe(spark)]
        both = reduce(region.intersection, takes)
        return region.difference(both, reduce(DataFrame.unionByName, cuts)) if cuts else both
    built = [build(spark, p, lookup) for p in parts]
    if name == "OR":
        return region.disjoint(reduce(DataFrame.unionByName, built)) if built else region.empty(spark)
    if name == "NOT":
        return region.complement(reduce(DataFrame.unionByName, built)) if built else region.universe(spark)
    if name == "XOR":
        return reduce(region.symmetric_difference, built) if built else region.empty(spark)
    raise parse_error(f"unknown variant `{name}`", RANGE)
