"""What results show of a box: its text, its center and its corners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions import geo
from tesseral.functions.boxes import id_text
from tesseral.operators.region import to_pure


def decorate(df: DataFrame, *, vertex: bool = False, center: bool = False, id_string: bool = False) -> DataFrame:
    """df with id_string, vertex and center; null where they are not asked for."""
    point = "struct<latitude:double,longitude:double,altitude:double>"
    return df.withColumns({
        "id_string": id_text() if id_string else F.lit(None).cast("string"),
        "vertex": geo.vertices() if vertex else F.lit(None).cast(f"array<{point}>"),
        "center": geo.center() if center else F.lit(None).cast(point),
    })


def get_value_rows(df: DataFrame, *, id_pure: bool = False, **flags: bool) -> DataFrame:
    """Cells are expanded first, then decorated one by one."""
    return decorate(to_pure(df) if id_pure else df, **flags)


def select_rows(df: DataFrame, *, id_pure: bool = False, **flags: bool) -> DataFrame:
    """Boxes are decorated first; their cells repeat the decoration."""
    shown = decorate(df, **flags)
    return to_pure(shown) if id_pure else shown
