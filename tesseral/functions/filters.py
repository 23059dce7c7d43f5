"""Predicates on values, by the type of their key; they reach the Parquet scan as pushed filters where Parquet has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = {"INT": "v_int", "TEXT": "v_text", "BOOLEAN": "v_bool", "FLOAT": "v_float"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _inside(v: Column, a: object) -> Column:
    return v.isin(list(a)) if a else F.lit(False)  # type: ignore[call-overload]


PREDICATES: dict[str, dict[str, Callable[..., Column]]] = {
    "BOOLEAN": {
        "IsTrue": lambda v, a: v == F.lit(True),
        "IsFalse": lambda v, a: v == F.lit(False),
        "Equals": lambda v, a: v == F.lit(a),
        "NotEquals": lambda v, a: v != F.lit(a),
    },
    "INT": {
        "Equal": lambda v, a: v == F.lit(a),
        "NotEqual": lambda v, a: v != F.lit(a),
        "GreaterThan": lambda v, a: v > F.lit(a),
        "GreaterEqual": lambda v, a: v >= F.lit(a),
        "LessThan": lambda v, a: v < F.lit(a),
        "LessEqual": lambda v, a: v <= F.lit(a),
        "Between": lambda v, a: v.between(*a),
        "In": _inside,
        "NotIn": lambda v, a: ~_inside(v, a),
    },
    "TEXT": {
        "Equal": lambda v, a: v == F.lit(a),
        "NotEqual": lambda v, a: v != F.lit(a),
        "Contains": lambda v, a: v.contains(a),
        "NotContains": lambda v, a: ~v.contains(a),
        "StartsWith": lambda v, a: v.startswith(a),
        "EndsWith": lambda v, a: v.endswith(a),
        "CaseInsensitiveEqual": lambda v, a: _ascii_lower(v) == F.lit(a.translate(str.maketrans(_UPPER, _LOWER))),
    },
}


def predicate(kind: str, name: str, argument: object = None, value: Column | None = None) -> Column:
    """The named predicate of a type, on its value column or another one."""
    return PREDICATES[kind][name](F.col(VALUE[kind]) if value is None else value, argument)
