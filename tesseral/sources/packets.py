"""Packets of commands in JSON: reading with checks, files, and the JSON Schema of the interface."""

from __future__ import annotations

import json
from pathlib import Path

from tesseral.functions.filters import PREDICATES

KINDS = ("INT", "TEXT", "BOOLEAN", "FLOAT")
_SHOW = {"vertex": "bool", "center": "bool", "id_string": "bool", "id_pure": "bool"}
_AT = {"spacename": "str", "keyname": "str"}
#: Fields of each command.
COMMANDS: dict[str, dict[str, str]] = {
    "Version": {},
    "Spaces": {},
    "AddSpace": {"spacename": "str"},
    "DeleteSpace": {"spacename": "str"},
    "AddKey": {**_AT, "type": "kind"},
    "DeleteKey": {"spacename": "str", "name": "str"},
    "Keys": {"spacename": "str"},
    "SetValue": {**_AT, "range": "range", "value": "value"},
    "PutValue": {**_AT, "range": "range", "value": "value"},
    "DeleteValue": {**_AT, "range": "range"},
    "GetValue": {**_AT, "range": "range", **_SHOW},
    "Select": {"range": "range", **_SHOW},
}
_AXIS = {"Single": 1, "LimitRange": 2, "BeforeUnLimitRange": 1, "AfterUnLimitRange": 1}


def value_of(value: dict) -> tuple[str, object]:
    ((kind, plain),) = value.items()
    return kind, plain


def _fail(text: str) -> None:
    raise ValueError(text)


def _int(v: object, low: int, high: int) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and low <= v <= high


def _variant(data: object, names: object) -> tuple[str, object]:
    if isinstance(data, str):
        name, body = data, None
    elif isinstance(data, dict) and len(data) == 1:
        ((name, body),) = data.items()
    else:
        _fail("expected a variant")
    if name not in names:  # type: ignore[operator]
        _fail(f"unknown variant `{name}`")
    return name, body


def check_value(value: object) -> None:
    kind, v = _variant(value, KINDS)
    good = {"INT": _int(v, -(2**31), 2**31 - 1), "TEXT": isinstance(v, str), "BOOLEAN": isinstance(v, bool), "FLOAT": isinstance(v, (int, float)) and not isinstance(v, bool)}[kind]
    good or _fail(f"invalid value for {kind}")


def check_filter(data: object) -> None:
    tag, chosen = _variant(data, ["FilterINT", "FilterTEXT", "FilterBOOLEAN"])
    kind = tag.removeprefix("Filter")
    name, v = _variant(chosen, PREDICATES[kind])
    many = name in ("In", "NotIn", "Between")
    values = v if many else [v]
    if name in ("IsTrue", "IsFalse"):
        good = v is None
    elif not isinstance(values, list) or name == "Between" and len(values) != 2:
        good = False
    else:
        good = all(_int(x, -(2**31), 2**31 - 1) if kind == "INT" else isinstance(x, str if kind == "TEXT" else bool) for x in values)
    good or _fail(f"invalid argument for {tag} {name}")


def check_range(data: object) -> None:
    kind, body = _variant(data, ["SpaceTimeIdSet", "Prefix", "Function"])
    if kind == "SpaceTimeIdSet":
        isinstance(body, list) or _fail("expected a sequence")
        for i in body:  # type: ignore[union-attr]
            isinstance(i, dict) and {"z", "f", "x", "y", "i", "t"} <= set(i) or _fail("missing field in a space-time id")
            _int(i["z"], 0, 2**16 - 1) and _int(i["i"], 0, 2**32 - 1) or _fail("invalid z or i")
            for a, low, high in (("f", -(2**63), 2**63 - 1), ("x", 0, 2**64 - 1), ("y", 0, 2**64 - 1), ("t", 0, 2**32 - 1)):
                if i[a] != "Any":
                    name, v = _variant(i[a], _AXIS)
                    parts = v if _AXIS[name] == 2 else [v]
                    isinstance(parts, list) and len(parts) == _AXIS[name] and all(_int(x, low, high) for x in parts) or _fail(f"invalid range for {a}")
    elif kind == "Prefix":
        _, parts = _variant(body, ["AND", "OR", "NOT", "XOR"])
        isinstance(parts, list) or _fail("expected a sequence")
        for p in parts:  # type: ignore[union-attr]
            check_range(p)
    else:
        name, call = _variant(body, ["HasValue", "FilterValue"])
        isinstance(call, dict) and all(isinstance(call.get(k), str) for k in _AT) or _fail("missing field in a function")
        if name == "FilterValue":
            check_filter(call.get("filter"))  # type: ignore[union-attr]


def read_packet(text: str) -> list[tuple[str, dict]]:
    """(command, fields) of a packet; one bad command makes the whole packet a ValueError."""
    packet = json.loads(text)
    if not isinstance(packet, dict) or not isinstance(packet.get("command"), list):
        _fail("missing field `command`")
    out = []
    for item in packet["command"]:
        name, body = _variant(item, COMMANDS)
        body = {} if body is None else body
        for field, kind in COMMANDS[name].items():
            if not isinstance(body, dict) or field not in body:
                _fail(f"missing field `{field}`")
            v = body[field]
            if kind == "range":
                check_range(v)
            elif kind == "value":
                check_value(v)
            elif kind == "kind":
                v in KINDS or _fail(f"unknown variant `{v}`")
            elif not isinstance(v, str if kind == "str" else bool):
                _fail(f"invalid type for `{field}`")
        out.append((name, body))
    return out


def read_file(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def write_file(path: str, results: str) -> None:
    Path(path).write_text(results + "\n", encoding="utf-8")


def input_schema() -> dict:
    """JSON Schema of a packet."""
    integer, axis = {"type": "integer"}, {"oneOf": [{"const": "Any"}, *[{"type": "object", "required": [k], "additionalProperties": False, "properties": {k: {"type": "integer"} if n == 1 else {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}}} for k, n in _AXIS.items()]]}
    only = lambda name, body: {"type": "object", "required": [name], "additionalProperties": False, "properties": {name: body}}
    fields = {
        "str": {"type": "string"},
        "bool": {"type": "boolean"},
        "kind": {"enum": list(KINDS)},
        "range": {"$ref": "#/$defs/Range"},
        "value": {"oneOf": [only(k, {"type": t}) for k, t in zip(KINDS, ("integer", "string", "boolean", "number"), strict=True)]},
    }
    commands = [{"const": n} if not f else only(n, {"type": "object", "required": list(f), "properties": {k: fields[v] for k, v in f.items()}}) for n, f in COMMANDS.items()]
    ids = {"type": "object", "required": ["z", "f", "x", "y", "i", "t"], "properties": {"z": integer, "i": integer, **dict.fromkeys("fxyt", axis)}}
    filters = {"oneOf": [only(f"Filter{k}", {"oneOf": [{"const": n} if n.startswith("Is") else only(n, {}) for n in names]}) for k, names in PREDICATES.items()]}
    call = {"type": "object", "required": ["spacename", "keyname"], "properties": {"spacename": fields["str"], "keyname": fields["str"], "filter": filters}}
    many = {"type": "array", "items": fields["range"]}
    tree = {"oneOf": [only("SpaceTimeIdSet", {"type": "array", "items": ids}), only("Prefix", {"oneOf": [only(n, many) for n in ("AND", "OR", "NOT", "XOR")]}), only("Function", {"oneOf": [only(n, call) for n in ("HasValue", "FilterValue")]})]}
    return {"type": "object", "required": ["command"], "properties": {"command": {"type": "array", "items": {"oneOf": commands}}}, "$defs": {"Range": tree}}


def output_schema() -> dict:
    """JSON Schema of the results."""
    point = {"type": "object", "properties": dict.fromkeys(("latitude", "longitude", "altitude"), {"type": "number"})}
    row = {"type": "object", "required": ["spacetimeid", "id_string", "vertex", "center"], "properties": {"spacetimeid": {"type": "object"}, "id_string": {"type": ["string", "null"]}, "vertex": {"type": ["array", "null"], "items": point}, "center": {"oneOf": [point, {"type": "null"}]}, "value": {"type": "object"}}}
    names = {"type": "array", "items": {"type": "string"}}
    bodies = {"SpaceNames": names, "KeyNames": names, "GetValue": {"type": "array", "items": row}, "SelectValue": {"type": "array", "items": row}, "Version": {"type": "string"}}
    success = {"oneOf": [{"const": "Success"}, *[{"type": "object", "required": [k], "properties": {k: v}} for k, v in bodies.items()]]}
    return {"type": "array", "items": {"oneOf": [{"type": "object", "required": ["Success"], "properties": {"Success": success}}, {"type": "object", "required": ["Error"], "properties": {"Error": {"type": "string"}}}]}}
