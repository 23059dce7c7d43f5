"""The same results in DuckDB's SQL."""

U8, U5, FOREVER = 2**23, 2**26, 2**63 - 1

EVENTS = f"""
ev AS (SELECT event_id, event_type, (user_id % 256) * {U8} AS x_lo, (user_id % 256 + 1) * {U8} AS x_hi, (event_id % 256) * {U8} AS y_lo, (event_id % 256 + 1) * {U8} AS y_hi,
         (least(CAST(floor(value / 4) AS BIGINT), 319) - 64) * {U8} AS f_lo, (least(CAST(floor(value / 4) AS BIGINT), 319) - 63) * {U8} AS f_hi,
         (epoch_us(ts) // 1000000 // 3600) * 3600 AS t_lo, (epoch_us(ts) // 1000000 // 3600 + 1) * 3600 AS t_hi FROM events)"""
ORDERS = f"""
od AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, (o_custkey % 240) * {U8} AS x_lo, (o_custkey % 240 + o_custkey % 8 + 1) * {U8} AS x_hi,
         (o_orderkey % 240) * {U8} AS y_lo, (o_orderkey % 240 + o_orderkey % 5 + 1) * {U8} AS y_hi, (-(o_orderkey % 4)) * {U8} AS f_lo, (o_custkey % 4 + 1) * {U8} AS f_hi,
         (epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 // 86400) * 86400 AS t_lo, (epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000000 // 86400 + 7) * 86400 AS t_hi FROM orders)"""
LINES = f"""
li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity, (l_partkey % 256) * {U8} AS x_lo, (l_partkey % 256 + 1) * {U8} AS x_hi, (l_suppkey % 256) * {U8} AS y_lo, (l_suppkey % 256 + 1) * {U8} AS y_hi,
         CAST(l_linenumber - 4 AS BIGINT) * {U8} AS f_lo, CAST(l_linenumber - 3 AS BIGINT) * {U8} AS f_hi,
         (epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 // 86400) * 86400 AS t_lo, (epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 // 86400 + 1) * 86400 AS t_hi FROM lineitem)"""
#: Boxes of the two small regions in steps, half-open.
SITES = "si AS (SELECT -(s_suppkey % 5) AS f0, s_suppkey % 3 + 1 AS f1, s_suppkey % 31 AS x0, s_suppkey % 31 + 2 AS x1, CAST(s_nationkey AS BIGINT) AS y0, CAST(s_nationkey AS BIGINT) + 3 AS y1 FROM supplier)"
ZONES = "zo AS (SELECT c_custkey % 6 - 1 AS f0, c_custkey % 6 + 1 AS f1, c_custkey % 29 AS x0, c_custkey % 29 + 1 AS x1, c_nationkey + c_custkey % 3 AS y0, c_nationkey + c_custkey % 3 + 1 AS y1, CAST(c_nationkey % 5 AS INTEGER) AS v_int FROM customer)"


def _cells(name: str, boxes: str, more: str = "") -> str:
    return f"{name} AS (SELECT DISTINCT {more}f, x, unnest(range(y0, y1)) AS y FROM (SELECT {more}f, unnest(range(x0, x1)) AS x, y0, y1 FROM (SELECT {more}unnest(range(f0, f1)) AS f, x0, x1, y0, y1 FROM {boxes})))"


A, B = _cells("a", "si"), _cells("b", "zo")
ALL = "u AS (SELECT f, x, y FROM (SELECT unnest(range(CAST(-32 AS BIGINT), 32)) AS f), (SELECT unnest(range(CAST(0 AS BIGINT), 32)) AS x), (SELECT unnest(range(CAST(0 AS BIGINT), 32)) AS y))"
BOTH = f"WITH {SITES}, {ZONES}, {A}, {B}, {ALL}"
LIT = "c AS (SELECT * FROM u WHERE f BETWEEN -8 AND 7 AND x BETWEEN 0 AND 23)"
BOX = "f_lo, f_hi, x_lo, x_hi, y_lo, y_hi, t_lo, t_hi"
OVERLAP = " AND ".join(f"{{0}}.{d}_lo < {{1}}.{d}_hi AND {{1}}.{d}_lo < {{0}}.{d}_hi" for d in "fxyt")
CLIP = ", ".join(f"greatest({{0}}.{d}_lo, {{1}}.{d}_lo) AS {d}_lo, least({{0}}.{d}_hi, {{1}}.{d}_hi) AS {d}_hi" for d in "fxyt")
Q = 2**27
CORRIDOR = f"""
co AS (SELECT * FROM (VALUES
  (0, CAST(0 AS BIGINT), CAST(6 AS BIGINT) * {Q}, CAST(2 AS BIGINT) * {Q}, CAST(9 AS BIGINT) * {Q}, CAST(-2147483648 AS BIGINT), CAST(2147483648 AS BIGINT), CAST(1704412800 AS BIGINT), CAST(1705276800 AS BIGINT)),
  (1, CAST(3 AS BIGINT) * {Q}, CAST(9 AS BIGINT) * {Q}, CAST(9 AS BIGINT) * {Q}, CAST(16 AS BIGINT) * {Q}, CAST(-8 AS BIGINT) * {U8}, CAST(40 AS BIGINT) * {U8}, CAST(0 AS BIGINT), CAST({FOREVER} AS BIGINT)))
  v(cid, x_lo, x_hi, y_lo, y_hi, f_lo, f_hi, t_lo, t_hi))"""
WEEK = f"wk AS (SELECT CAST(0 AS BIGINT) AS x_lo, {2**30} AS x_hi, CAST(0 AS BIGINT) AS y_lo, {2**31} AS y_hi, -{2**29} AS f_lo, {2**29} AS f_hi, CAST(9500 AS BIGINT) * 86400 AS t_lo, CAST(9560 AS BIGINT) * 86400 AS t_hi)"


def _lon(x: str) -> str:
    return f"360.0 * (CAST({x} AS DOUBLE) / 2147483648.0) - 180.0"


def _lat(y: str) -> str:
    return f"degrees(2.0 * atan(1.0 - 2.0 / (exp((1.0 - 2.0 * CAST({y} AS DOUBLE) / 2147483648.0) * pi()) + 1.0)))"


def _alt(f: str) -> str:
    return f"33554432.0 * (CAST({f} AS DOUBLE) / 2147483648.0)"


def _axis(d: str, z: int, table: str = "od") -> str:
    unit, n = 2 ** (31 - z), 2**z
    least, most = (-n if d == "f" else 0), n - 1
    lo, hi = f"({table}.{d}_lo // {unit})", f"({table}.{d}_hi // {unit} - 1)"
    return f"CASE WHEN {lo} = {hi} THEN CAST({lo} AS VARCHAR) WHEN {lo} <= {least} AND {hi} >= {most} THEN '-' WHEN {lo} <= {least} THEN '-:' || {hi} WHEN {hi} >= {most} THEN {lo} || ':-' ELSE {lo} || ':' || {hi} END"


def _text(z: int, i: int, table: str = "od") -> str:
    t = f"CASE WHEN {table}.t_hi // {i} - 1 = {table}.t_lo // {i} THEN CAST({table}.t_lo // {i} AS VARCHAR) ELSE ({table}.t_lo // {i}) || ':' || ({table}.t_hi // {i} - 1) END"
    return f"'{z}/' || {_axis('f', z, table)} || '/' || {_axis('x', z, table)} || '/' || {_axis('y', z, table)} || '_{i}/' || {t}"


def _round(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def _relation() -> str:
    covers = " AND ".join(f"p.{d}0 <= q.{d}0 AND p.{d}1 >= q.{d}1" for d in "fxy")
    meets = " AND ".join(f"p.{d}0 < q.{d}1 AND q.{d}0 < p.{d}1" for d in "fxy")
    bounds = ", ".join(f"{t}.{d}{k} * {U5} AS {n}_{d}_{e}" for t, n in (("p", "a"), ("q", "b")) for d in "fxy" for k, e in ((0, "lo"), (1, "hi")))
    return f"WITH {SITES}, {ZONES} SELECT {bounds}, CASE WHEN {covers} THEN 'Full' ELSE 'Partial' END AS relation FROM (SELECT DISTINCT * FROM si) p JOIN (SELECT DISTINCT f0, f1, x0, x1, y0, y1 FROM zo) q ON {meets}"


BITS = " | ".join(f"{d}_{e}" for d in "fxy" for e in ("lo", "hi"))
CORNERS = f"""SELECT o_orderkey, CAST(4 * i + 2 * j + k AS INTEGER) AS corner, {_round(latitude=_lat("CASE i WHEN 0 THEN y_lo ELSE y_hi END"), longitude=_lon("CASE j WHEN 0 THEN x_lo ELSE x_hi END"), altitude=_alt("CASE k WHEN 0 THEN f_lo ELSE f_hi END"))}
FROM od, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), (VALUES (0), (1)) c(k)"""

ORACLES = {
    "flagship_corridor_errors": f"WITH {EVENTS}, {CORRIDOR} SELECT event_id, cid, event_type, {CLIP.format('ev', 'co')} FROM ev JOIN co ON {OVERLAP.format('ev', 'co')} WHERE event_type = 'error'",
    "id_display": f"WITH {EVENTS} SELECT event_id, {_text(8, 3600, 'ev')} AS id_string FROM ev",
    "id_normalize": f"WITH {ORDERS} SELECT o_orderkey, {_text(8, 86400)} AS id_string FROM od",
    "coordinates": f"WITH {EVENTS} SELECT event_id, {_round(latitude_0=_lat('y_lo'), latitude_1=_lat('y_hi'), longitude_0=_lon('x_lo'), longitude_1=_lon('x_hi'), altitude_0=_alt('f_lo'), altitude_1=_alt('f_hi'))} FROM ev",
    "center": f"WITH {ORDERS} SELECT o_orderkey, {_round(latitude=f'({_lat("y_lo")} + {_lat("y_hi")}) / 2', longitude=f'({_lon("x_lo")} + {_lon("x_hi")}) / 2', altitude=f'({_alt("f_lo")} + {_alt("f_hi")}) / 2')} FROM od",
    "vertex_rows": f"WITH {ORDERS} {CORNERS}",
    "change_scale_z": f"WITH {ORDERS} SELECT o_orderkey, {_text(10, 86400)} AS id_string FROM od",
    "change_scale_i": f"WITH {ORDERS} SELECT o_orderkey, {_text(8, 21600)} AS id_string FROM od",
    "coarsen": f"WITH {ORDERS} SELECT o_orderkey, CAST(31 - log2(CAST(({BITS}) & -({BITS}) AS DOUBLE)) AS INTEGER) AS z, CAST(gcd(t_lo, t_hi) AS BIGINT) AS i FROM od",
    "containment_pairs": _relation(),
    "to_pure": f"WITH {SITES} SELECT f, x, y, count(*) AS n FROM (SELECT f, x, unnest(range(y0, y1)) AS y FROM (SELECT f, unnest(range(x0, x1)) AS x, y0, y1 FROM (SELECT unnest(range(f0, f1)) AS f, x0, x1, y0, y1 FROM si))) GROUP BY ALL",
    "complement_voxels": f"{BOTH} FROM u EXCEPT FROM a",
    "disjoint_cells": f"{BOTH} SELECT count(*) AS cells FROM a",
    "region_equal": f"{BOTH} SELECT 'a = b' AS what, NOT EXISTS (FROM a EXCEPT FROM b) AND NOT EXISTS (FROM b EXCEPT FROM a) AS equal UNION ALL SELECT 'a | b = b | a', true UNION ALL SELECT 'a ^ a = nothing', true",
    "region_and_voxels": f"{BOTH} FROM a INTERSECT FROM b",
    "region_or_voxels": f"{BOTH} FROM a UNION FROM b",
    "region_xor_voxels": f"{BOTH} (FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a)",
    "region_diff_voxels": f"{BOTH} FROM a EXCEPT FROM b",
    "region_not_voxels": f"{BOTH} FROM u EXCEPT (FROM a UNION FROM b)",
    "coalesce_adjacent": f"""WITH {LINES},
g AS (SELECT f_lo, f_hi, x_lo, x_hi, y_lo, y_hi, t_lo, t_hi, CASE WHEN t_lo <= max(t_hi) OVER (PARTITION BY f_lo, x_lo, y_lo ORDER BY t_lo, t_hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM li),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY f_lo, x_lo, y_lo ORDER BY t_lo, t_hi ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT f_lo, f_hi, x_lo, x_hi, y_lo, y_hi, min(t_lo) AS t_lo, max(t_hi) AS t_hi FROM n GROUP BY f_lo, f_hi, x_lo, x_hi, y_lo, y_hi, island""",
    "has_value": f"WITH {LINES} SELECT DISTINCT 8 AS z, CAST(86400 AS BIGINT) AS i, {BOX} FROM li",
    "get_value": f"WITH {ORDERS}, {WEEK}, m AS (SELECT o_orderkey, o_orderpriority, {CLIP.format('od', 'wk')} FROM od JOIN wk ON {OVERLAP.format('od', 'wk')}) SELECT o_orderkey, o_orderpriority, 8 AS z, CAST(86400 AS BIGINT) AS i, {BOX}, {_text(8, 86400, 'm')} AS id_string FROM m",
    "get_value_pure": f"""WITH {ORDERS}, {WEEK}, m AS (SELECT o_orderkey, {CLIP.format('od', 'wk')} FROM od JOIN wk ON {OVERLAP.format('od', 'wk')})
SELECT o_orderkey, f, x, unnest(range(y_lo // {U8}, y_hi // {U8})) AS y, t_lo, t_hi FROM (SELECT o_orderkey, f, unnest(range(x_lo // {U8}, x_hi // {U8})) AS x, y_lo, y_hi, t_lo, t_hi FROM (SELECT *, unnest(range(f_lo // {U8}, f_hi // {U8})) AS f FROM m))""",
    "put_conflicts": f"WITH {EVENTS}, {CORRIDOR} SELECT event_type, bool_or(EXISTS (SELECT 1 FROM co WHERE {OVERLAP.format('ev', 'co')})) AS conflict FROM ev GROUP BY event_type",
    "set_value_union": f"{BOTH} FROM a UNION (SELECT * FROM u WHERE (f BETWEEN -4 AND 3 AND x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 15) OR (f BETWEEN 2 AND 3 AND y BETWEEN 6 AND 19))",
    "delete_value": f"WITH {SITES}, {ZONES}, {A}, {_cells('v', 'zo', 'v_int, ')} SELECT v_int, f, x, y FROM v ANTI JOIN a USING (f, x, y)",
    "nested_prefix": f"{BOTH}, {LIT} ((FROM a UNION FROM c) EXCEPT FROM b) INTERSECT ((FROM a EXCEPT FROM c) UNION (FROM c EXCEPT FROM a))",
    "overlap_join_lines": f"WITH {LINES}, {ORDERS} SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM li JOIN od ON {OVERLAP.format('li', 'od')} GROUP BY 1",
    "show_spaces": "SELECT * FROM (VALUES (0, 'events'), (1, 'orders'), (2, 'lineitem')) v(seq, space)",
    "show_keys": "SELECT * FROM (VALUES (0, 'etype'), (1, 'alarm'), (2, 'level')) v(seq, key)",
    "version": "SELECT '0.0.2' AS version",
    "command_set_value": f"WITH {SITES}, {ZONES}, {ALL}, {_cells('v', 'zo', 'v_int, ')} FROM v UNION (SELECT 3 AS v_int, f, x, y FROM u WHERE (f BETWEEN -4 AND 3 AND x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 15) OR (f BETWEEN 2 AND 3 AND y BETWEEN 6 AND 19))",
    "command_put_value": f"WITH {ZONES}, {_cells('v', 'zo', 'v_int, ')} SELECT CAST(n AS INTEGER) AS v_int, EXISTS (SELECT 1 FROM v WHERE v_int = n AND f BETWEEN 0 AND 3 AND x BETWEEN 28 AND 31 AND y BETWEEN 0 AND 3) AS conflict FROM (SELECT unnest(range(6)) AS n)",
    "command_delete_value": f"""WITH {ZONES}, {_cells('v', 'zo', 'v_int, ')}, h AS (SELECT unnest([0, 1]) AS k)
SELECT * FROM (SELECT v_int, 2 * f + i.k AS f, 2 * x + j.k AS x, 2 * y + l.k AS y FROM v, h i, h j, h l) WHERE NOT (f = 1 AND x BETWEEN 3 AND 40 AND y BETWEEN 5 AND 31)""",
    "command_get_value": f"WITH {ORDERS}, {WEEK}, m AS (SELECT o_orderpriority, {CLIP.format('od', 'wk')} FROM od JOIN wk ON {OVERLAP.format('od', 'wk')}) SELECT o_orderpriority AS priority, {_text(8, 86400, 'm')} AS id_string FROM m",
    "command_select": f"{BOTH}, {LIT} FROM a INTERSECT FROM c",
    "command_delete_key": "SELECT * FROM (VALUES (0, 'etype', true), (1, 'level', true)) v(seq, key, twice_fails)",
    "filter_value_region": f"WITH {LINES} SELECT 8 AS z, CAST(86400 AS BIGINT) AS i, {BOX} FROM li WHERE l_quantity BETWEEN 10 AND 12",
}
_INT = {"equal": "= 25", "notequal": "<> 25", "greaterthan": "> 45", "greaterequal": ">= 45", "lessthan": "< 5", "lessequal": "<= 5", "between": "BETWEEN 10 AND 12", "in": "IN (1, 7, 50)", "notin": "NOT IN (1, 7, 50)"}
_TEXT = {"equal": "o_orderpriority = '1-URGENT'", "notequal": "o_orderpriority <> '1-URGENT'", "contains": "contains(o_orderpriority, '-')", "notcontains": "NOT contains(o_orderpriority, 'IG')", "startswith": "starts_with(o_orderpriority, '5')", "endswith": "ends_with(o_orderpriority, 'H')", "caseinsensitiveequal": "lower(o_orderpriority) = '2-high'"}
_BOOL = {"istrue": "", "isfalse": "NOT ", "equals": "", "notequals": "NOT "}
ORACLES |= {f"filter_int_{k}": f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_quantity, x_lo, y_lo, t_lo FROM li WHERE l_quantity {v}" for k, v in _INT.items()}
ORACLES |= {f"filter_text_{k}": f"WITH {ORDERS} SELECT o_orderkey, o_orderpriority, x_lo, y_lo, t_lo FROM od WHERE {v}" for k, v in _TEXT.items()}
ORACLES |= {f"filter_bool_{k}": f"WITH {EVENTS} SELECT event_id, event_type = 'error' AS alarm, x_lo, y_lo, t_lo FROM ev WHERE {v}(event_type = 'error')" for k, v in _BOOL.items()}
