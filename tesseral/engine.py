"""Spaces, keys and values, and the command interface over them.

Values are rows of ``cells``: a value of the key's type and a box where it holds. Each key has a table of its own in the shared
folder, so a query reads only the keys that it names, and filters on values reach the scan. A bulk load adds files to the table; any other
change writes it anew, and the table before stays for frames that were made of it, the one before that is dropped. The catalog of spaces and keys
is a small driver-side structure, in order of creation. ``execute`` gives JSON, so what it returns passes through the driver: large results are
for get_value() and select(), which give DataFrames, and write_rows().
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral import __version__, errors
from tesseral.functions.boxes import clipped, id_text, shared_resolution
from tesseral.functions.filters import VALUE, predicate
from tesseral.model import BOX, Identifier
from tesseral.operators import region
from tesseral.operators.decorate import get_value_rows, select_rows
from tesseral.operators.join import overlap_join, prefixed
from tesseral.plans.ranges import build, is_disjoint
from tesseral.shared import Table, written
from tesseral.sources.packets import read_packet, value_of

#: Clashing boxes that an error names; it counts the others.
NAMED = 20
VALUES = "v_int int, v_text string, v_bool boolean, v_float float, seq long"
_NAME = re.compile(r"[-A-Za-z0-9_.@+=]*")


def valid_name(name: str) -> bool:
    return len(name.encode()) <= 256 and _NAME.fullmatch(name) is not None


class Engine:
    """A store that lasts as long as the object; ``execute`` takes packets of commands."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.spaces: dict[str, dict[str, str]] = {}
        self.tables: dict[tuple[str, str], list[Table]] = {}
        self.sequence = 0

    # --- catalog -------------------------------------------------------------------------------------------------

    def add_space(self, name: str) -> None:
        if not valid_name(name):
            raise errors.invalid_space(name, errors.ADD_SPACE_NAME)
        if name in self.spaces:
            raise errors.space_exists(name, errors.ADD_SPACE)
        self.spaces[name] = {}

    def delete_space(self, name: str) -> None:
        self._space(name, errors.GET_SPACE)
        for key in self.spaces.pop(name):
            self.tables.pop((name, key), None)

    def add_key(self, space: str, name: str, kind: str) -> None:
        if not valid_name(name):
            raise errors.invalid_key(name, errors.ADD_KEY_NAME)
        keys = self._space(space, errors.GET_SPACE)
        if name in keys:
            raise errors.key_exists(name, space, errors.ADD_KEY)
        keys[name] = kind

    def delete_key(self, space: str, name: str) -> None:
        if not valid_name(name):
            raise errors.invalid_key(name, errors.DELETE_KEY_NAME)
        self._key(space, name, errors.GET_KEY)
        del self.spaces[space][name]
        self.tables.pop((space, name), None)

    def keys(self, space: str) -> list[str]:
        return list(self._space(space, errors.GET_SPACE))

    def _space(self, name: str, where: str) -> dict[str, str]:
        if name not in self.spaces:
            raise errors.space_missing(name, where)
        return self.spaces[name]

    def _key(self, space: str, name: str, where: str) -> str:
        keys = self._space(space, errors.GET_SPACE)
        if name not in keys:
            raise errors.key_missing(name, space, where)
        return keys[name]

    # --- values --------------------------------------------------------------------------------------------------

    def cells(self, space: str, key: str) -> DataFrame:
        """The rows of a key: z, i, bounds, the four value columns, and seq, the order of the values."""
        self._key(space, key, errors.GET_KEY)
        have = self.tables.get((space, key))
        return have[-1].read() if have else self.spark.createDataFrame([], f"{region.SCHEMA}, {VALUES}")

    def _replace(self, space: str, key: str, rows: DataFrame) -> None:
        """A new table of the key; of those before, the last stays."""
        old = self.tables.get((space, key), [])
        self.tables[space, key] = [*old[-1:], Table(rows, "cells")]
        for table in old[:-1]:
            table.drop()

    def load(self, space: str, key: str, df: DataFrame, value: str) -> None:
        """Bulk form of SetValue: the boxes of df with the value in a column. Boxes of one value may then overlap."""
        kind = self._key(space, key, errors.GET_KEY)
        rows = df.select(*region.REGION, *[(F.col(value) if c == VALUE[kind] else F.lit(None)).cast(t).alias(c) for c, t in zip(VALUE.values(), ("int", "string", "boolean", "float"), strict=True)])
        self.sequence += 1
        rows = rows.withColumn("seq", F.lit(self.sequence).cast("long"))
        if (space, key) in self.tables:
            self.tables[space, key][-1].append(rows)
        else:
            self._replace(space, key, rows)

    def lookup(self, space: str, key: str, condition: dict | None) -> DataFrame:
        """The region of a key's values that fit a filter, or of all."""
        cells = self.cells(space, key)
        if condition is not None:
            ((tag, chosen),) = condition.items()
            kind = tag.removeprefix("Filter")
            if self.spaces[space][key] != kind:
                raise errors.filter_mismatch(kind, "filter", errors.FILTER)
            name, argument = (chosen, None) if isinstance(chosen, str) else next(iter(chosen.items()))
            cells = cells.filter(predicate(kind, name, argument))
        return cells.select(*region.REGION)

    def range(self, node: dict) -> DataFrame:
        """The region of an expression, in boxes that share nothing."""
        built = build(self.spark, node, self.lookup)
        return built if is_disjoint(node) else region.disjoint(built)

    def _typed(self, space: str, key: str, value: dict, where: str) -> tuple[str, object]:
        kind = self._key(space, key, errors.GET_KEY)
        received, plain = value_of(value)
        if received != kind:
            raise errors.value_mismatch(kind, received, where)
        return kind, plain

    def _of_value(self, cells: DataFrame, kind: str, value: object) -> DataFrame:
        return cells.filter(F.col(VALUE[kind]) == F.lit(value).cast(cells.schema[VALUE[kind]].dataType))

    def set_value(self, space: str, key: str, node: dict, value: dict) -> None:
        """Adds the region to the value; regions of other values stay as they are."""
        area = written(self.range(node), "range")
        kind, plain = self._typed(space, key, value, errors.SET)
        cells = self.cells(space, key)
        same = self._of_value(cells, kind, plain)
        before = same.agg(F.min("seq")).first()[0]
        if before is None:
            self.sequence += 1
        whole = region.coalesce(region.union(same, area), None)
        rows = whole.select("*", *[F.lit(plain if c == VALUE[kind] else None).cast(cells.schema[c].dataType).alias(c) for c in VALUE.values()], F.lit(before or self.sequence).cast("long").alias("seq"))
        rest = cells.filter(~F.coalesce(F.col(VALUE[kind]) == F.lit(plain).cast(cells.schema[VALUE[kind]].dataType), F.lit(False)))
        self._replace(space, key, rest.unionByName(rows))

    def put_value(self, space: str, key: str, node: dict, value: dict) -> None:
        """As set_value, but an error if the value holds somewhere in the region already."""
        area = written(self.range(node), "range")
        kind, plain = self._typed(space, key, value, errors.PUT)
        same = self._of_value(self.cells(space, key), kind, plain).select(*region.REGION)
        clash = region.intersection(same, area)
        if not clash.isEmpty():
            clash = written(clash.select(id_text().alias("id")), "clash")
            ids = [r[0] for r in clash.orderBy("id").limit(NAMED).collect()]
            more = clash.count() - len(ids)
            raise errors.value_exists(", ".join(ids) + (f" and {more} more" if more else ""), errors.PUT)
        self.set_value(space, key, node, value)

    def delete_value(self, space: str, key: str, node: dict) -> None:
        """Takes the region from every value; values without a region are gone."""
        area = written(self.range(node), "range")
        cells = self.cells(space, key)
        self._replace(space, key, without(cells, area))

    def get_value(self, space: str, key: str, node: dict, **flags: bool) -> DataFrame:
        """Values and where they hold in the region: one row per box, or cell with id_pure."""
        area = self.range(node)
        return get_value_rows(values_in(self.cells(space, key), area), **flags)

    def select(self, node: dict, **flags: bool) -> DataFrame:
        try:
            return select_rows(self.range(node), **flags)
        except errors.EngineError as e:
            raise errors.parse_error(str(e), errors.SELECT) from e

    # --- packets -------------------------------------------------------------------------------------------------

    def execute(self, packet: str) -> str:
        """The JSON results of a JSON packet, one entry per command; a failed command doesn't stop the later ones."""
        try:
            commands = read_packet(packet)
        except ValueError as e:
            return json.dumps([{"Error": str(errors.parse_error(str(e), errors.PACKET))}])
        return json.dumps([self._one(name, body) for name, body in commands], indent=2, ensure_ascii=False)

    def _one(self, name: str, body: dict) -> dict:
        try:
            return {"Success": _COMMANDS[name](self, body)}
        except errors.EngineError as e:
            return {"Error": str(e)}


def values_in(cells: DataFrame, area: DataFrame) -> DataFrame:
    """cells clipped to a region."""
    pairs = overlap_join(prefixed(cells, "a_"), prefixed(area.select(*region.REGION), "b_"))
    return pairs.select(*shared_resolution("a_", "b_"), *clipped("a_", "b_"), *[F.col(f"a_{c}").alias(c) for c in cells.columns if c not in region.REGION])


def without(cells: DataFrame, area: DataFrame) -> DataFrame:
    """cells outside a region: each part keeps its row's value, and a resolution at which its bounds are whole steps."""
    return region.outside(cells, area)


def write_rows(df: DataFrame, path: str) -> None:
    """Rows of get_value() or select() as JSON lines, written by Spark: the identifier's text, what was asked for, and the value."""
    value = [F.coalesce(*[F.col(c).cast("string") for c in VALUE.values()]).alias("value")] if "seq" in df.columns else []
    df.select(id_text().alias("spacetimeid"), "id_string", "vertex", "center", *value).write.mode("overwrite").json(path)


def _json_rows(df: DataFrame, value: bool) -> list[dict]:
    out = []
    for r in (row.asDict(True) for row in df.orderBy(*(["seq"] if value else []), *BOX).toLocalIterator()):
        item = {"spacetimeid": Identifier.from_box(r).json(), **{k: r[k] for k in ("id_string", "vertex", "center")}}
        if value:
            item["value"] = next({k: r[c]} for k, c in VALUE.items() if r[c] is not None)
        out.append(item)
    return out


_FLAGS = ("vertex", "center", "id_string", "id_pure")


def _flags(b: dict) -> dict[str, bool]:
    return {k: b[k] for k in _FLAGS}


def _done(_: None) -> str:
    return "Success"


_COMMANDS: dict[str, Callable[[Engine, dict], object]] = {
    "Version": lambda e, b: {"Version": __version__},
    "Spaces": lambda e, b: {"SpaceNames": list(e.spaces)},
    "AddSpace": lambda e, b: _done(e.add_space(b["spacename"])),
    "DeleteSpace": lambda e, b: _done(e.delete_space(b["spacename"])),
    "AddKey": lambda e, b: _done(e.add_key(b["spacename"], b["keyname"], b["type"])),
    "DeleteKey": lambda e, b: _done(e.delete_key(b["spacename"], b["name"])),
    "Keys": lambda e, b: {"KeyNames": e.keys(b["spacename"])},
    "SetValue": lambda e, b: _done(e.set_value(b["spacename"], b["keyname"], b["range"], b["value"])),
    "PutValue": lambda e, b: _done(e.put_value(b["spacename"], b["keyname"], b["range"], b["value"])),
    "DeleteValue": lambda e, b: _done(e.delete_value(b["spacename"], b["keyname"], b["range"])),
    "GetValue": lambda e, b: {"GetValue": _json_rows(e.get_value(b["spacename"], b["keyname"], b["range"], **_flags(b)), True)},
    "Select": lambda e, b: {"SelectValue": _json_rows(e.select(b["range"], **_flags(b)), False)},
}
