from __future__ import annotations

import json

import pytest

from tesseral.engine import Engine
from tesseral.sources.packets import input_schema, output_schema


def lit(x, z=4, i=60, t=None):
    return {"SpaceTimeIdSet": [{"z": z, "f": {"Single": 5}, "x": x, "y": "Any", "i": i, "t": t or {"Single": 100}}]}


def run(engine, *commands):
    return json.loads(engine.execute(json.dumps({"command": list(commands)})))


def get(range_, **flags):
    return {"GetValue": {"spacename": "city", "keyname": "risk", "range": range_, "vertex": False, "center": False, "id_string": True, "id_pure": False} | flags}


AT = {"spacename": "city", "keyname": "risk"}
HAS = {"Function": {"HasValue": AT}}


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    assert run(e, {"AddSpace": {"spacename": "city"}}, {"AddKey": AT | {"type": "INT"}}) == [{"Success": "Success"}] * 2
    return e


def test_version_and_names(spark):
    e = Engine(spark)
    assert run(e, "Version") == [{"Success": {"Version": "0.0.2"}}]
    out = run(e, {"AddSpace": {"spacename": "b"}}, {"AddSpace": {"spacename": "a"}}, {"AddSpace": {"spacename": "a"}}, {"AddSpace": {"spacename": "a b"}}, {"AddSpace": {"spacename": "x" * 257}}, "Spaces", {"DeleteSpace": {"spacename": "b"}}, {"DeleteSpace": {"spacename": "b"}}, "Spaces")
    assert out[2]["Error"].startswith("Space 'a' already exists")
    assert out[3]["Error"].startswith("Invalid space name 'a b': only") and "Error" in out[4]
    assert out[5] == {"Success": {"SpaceNames": ["b", "a"]}}
    assert out[7]["Error"].startswith("Space 'b' not found")
    assert out[8] == {"Success": {"SpaceNames": ["a"]}}


def test_keys(engine):
    out = run(engine, {"AddKey": AT | {"type": "TEXT"}}, {"AddKey": {"spacename": "no", "keyname": "k", "type": "INT"}}, {"AddKey": {"spacename": "city", "keyname": "k", "type": "FLOAT"}}, {"Keys": {"spacename": "city"}}, {"DeleteKey": {"spacename": "city", "name": "k"}}, {"DeleteKey": {"spacename": "city", "name": "k"}})
    assert out[0]["Error"].startswith("Key 'risk' already exists in space 'city'")
    assert "not found" in out[1]["Error"]
    assert out[3] == {"Success": {"KeyNames": ["risk", "k"]}}
    assert out[5]["Error"].startswith("Key 'k' not found in space 'city'")


def test_set_get_put_delete(engine):
    setv = lambda kind, x, v: {kind: AT | {"range": lit(x), "value": {"INT": v}}}
    ids = lambda out: [(r["id_string"], r["value"]["INT"]) for r in out["Success"]["GetValue"]]
    out = run(engine, setv("SetValue", {"Single": 3}, 1), setv("SetValue", {"Single": 3}, 2), get(HAS))
    assert ids(out[2]) == [("4/5/3/-_60/100", 1), ("4/5/3/-_60/100", 2)]
    out = run(engine, setv("PutValue", {"Single": 3}, 1), setv("PutValue", {"Single": 4}, 1), get(HAS), {"DeleteValue": AT | {"range": lit({"Single": 3})}}, get(HAS), get(HAS, id_pure=True))
    assert out[0]["Error"].startswith("Value already exists for SpaceTimeId '4/5/3/-_60/100'")
    assert sorted(ids(out[2])) == [("4/5/3/-_60/100", 1), ("4/5/3/-_60/100", 2), ("4/5/4/-_60/100", 1)]
    assert ids(out[4]) == [("4/5/4/-_60/100", 1)]
    assert len(ids(out[5])) == 16


def test_delete_inside(engine):
    out = run(engine, {"SetValue": AT | {"range": lit({"LimitRange": [0, 2]}), "value": {"INT": 1}}}, {"DeleteValue": AT | {"range": lit({"Single": 1})}}, get(HAS))
    assert sorted(r["id_string"] for r in out[2]["Success"]["GetValue"]) == ["4/5/0/-_60/100", "4/5/2/-_60/100"]


def test_types(engine):
    out = run(
        engine,
        {"SetValue": AT | {"range": lit({"Single": 3}), "value": {"TEXT": "a"}}},
        get({"Function": {"FilterValue": AT | {"filter": {"FilterTEXT": {"Equal": "a"}}}}}),
        {"Select": {"range": lit({"Single": 99}), "vertex": False, "center": False, "id_string": False, "id_pure": False}},
        "Version",
    )
    assert out[0]["Error"].startswith("Type mismatch: expected 'INT' but received 'TEXT'")
    assert out[1]["Error"].startswith("Type mismatch: expected 'TEXT' type for filter operation")
    assert out[2]["Error"].startswith("Parse error: Parse error: Invalid x dimension")
    assert "Success" in out[3]


def test_select_prefixes(engine):
    select = lambda tree: run(engine, {"Select": {"range": tree, "vertex": False, "center": True, "id_string": True, "id_pure": False}})[0]["Success"]["SelectValue"]
    one, two = lit({"LimitRange": [0, 3]}), lit({"LimitRange": [2, 5]})
    assert [r["id_string"] for r in select({"Prefix": {"AND": [one, two]}})] == ["4/5/2:3/-_60/100"]
    assert select({"Prefix": {"AND": []}}) == select({"Prefix": {"OR": []}}) == select({"Prefix": {"XOR": []}}) == []
    assert [r["id_string"] for r in select({"Prefix": {"NOT": []}})] == ["0/-/-/-_0/-"]
    assert sorted(r["id_string"] for r in select({"Prefix": {"XOR": [one, two]}})) == ["4/5/-:1/-_60/100", "4/5/4:5/-_60/100"]
    assert [r["id_string"] for r in select({"Prefix": {"AND": [one, {"Prefix": {"NOT": [two]}}]}})] == ["4/5/-:1/-_60/100"]


def test_bad_packets(engine):
    for text in ("{", "[]", '{"command": ["Nothing"]}', json.dumps({"command": ["Version", {"AddSpace": {}}]}), json.dumps({"command": [get({"SpaceTimeIdSet": [{"z": 1}]})]}), json.dumps({"command": [get({"Function": {"FilterValue": AT | {"filter": {"FilterINT": {"Equal": "a"}}}}})]})):
        (out,) = json.loads(engine.execute(text))
        assert out["Error"].startswith("Parse error")


def test_other_types_and_bulk(spark, engine):
    from tesseral.model import Identifier, Span
    from tesseral.operators import region

    run(engine, *[{"AddKey": {"spacename": "city", "keyname": k, "type": k}} for k in ("TEXT", "BOOLEAN", "FLOAT")])
    for k, v in (("TEXT", "a"), ("BOOLEAN", True), ("FLOAT", 1.5)):
        at = {"spacename": "city", "keyname": k}
        out = run(engine, {"SetValue": at | {"range": lit({"Single": 3}), "value": {k: v}}}, {"GetValue": get(HAS)["GetValue"] | at | {"range": {"Function": {"HasValue": at}}}})
        assert out[1]["Success"]["GetValue"][0]["value"] == {k: v}
    rows = region.literal(spark, [Identifier.new(2, Span(0, 0), Span(1, 1), Span(1, 1))]).selectExpr("*", "5 AS level")
    engine.load("city", "risk", rows, "level")
    assert run(engine, get(HAS))[0]["Success"]["GetValue"][0]["value"] == {"INT": 5}


def test_loads_add_and_tables_go(spark, engine, tmp_path):
    """Loads add files to a table; of the tables that changes replace, only the last before stays."""
    import os

    from tesseral.engine import NAMED, write_rows
    from tesseral.model import Identifier, Span
    from tesseral.operators import region

    rows = lambda x: region.literal(spark, [Identifier.new(8, Span(5, 5), Span(x, x), Span(y, y)) for y in range(0, 60, 2)]).selectExpr("*", "5 AS level")
    for x in (1, 2):
        engine.load("city", "risk", rows(x), "level")
    table = engine.tables["city", "risk"]
    assert len(table) == 1 and engine.cells("city", "risk").count() == 60
    whole = {"SpaceTimeIdSet": [{"z": 0, "f": "Any", "x": "Any", "y": "Any", "i": 0, "t": "Any"}]}
    (out,) = run(engine, {"PutValue": AT | {"range": whole, "value": {"INT": 5}}})
    assert out["Error"].count("8/5/") == NAMED and " and 40 more" in out["Error"]
    paths = [table[0].path]
    for x in (1, 2):
        run(engine, {"DeleteValue": AT | {"range": {"SpaceTimeIdSet": [{"z": 8, "f": "Any", "x": {"Single": x}, "y": {"LimitRange": [0, 29]}, "i": 0, "t": "Any"}]}}})
        paths.append(engine.tables["city", "risk"][-1].path)
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True, True]
    write_rows(engine.get_value("city", "risk", whole, id_string=True), str(tmp_path / "rows"))
    read = spark.read.json(str(tmp_path / "rows"))
    assert read.count() == 30 and read.filter("spacetimeid = id_string and value = '5'").count() == 30


def test_stream(spark, engine, tmp_path):
    from tesseral.sources import layers
    from tesseral.streaming.ingest import ingest

    lines = layers.lineitem(spark, "/root/testdata/sf0.001")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    ingest(stream, engine, "city", "risk", "l_quantity", str(tmp_path / "check")).awaitTermination(120)
    assert engine.cells("city", "risk").count() == lines.count()


def test_cli_and_schema(tmp_path, capsys, spark):
    from tesseral.__main__ import main

    packet, result = tmp_path / "p.json", tmp_path / "r.json"
    packet.write_text('{"command": ["Version"]}')
    assert main([str(packet), str(result)]) == 0
    assert json.loads(result.read_text()) == [{"Success": {"Version": "0.0.2"}}]
    assert main(["--schema"]) == 0 and main([]) == 2
    assert set(json.loads(capsys.readouterr().out)) == {"input", "output"}
    assert input_schema()["required"] == ["command"] and output_schema()["type"] == "array"
