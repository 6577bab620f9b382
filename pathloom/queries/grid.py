"""Queries over the derived grid and their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..plans import derived as D

FLAGS_SQL = "flags(dx, dy, flag) AS (VALUES (0,-1,1),(0,1,2),(1,0,4),(-1,0,8),(1,-1,16),(-1,-1,32),(1,1,64),(-1,1,128))"
MOVES_SQL = "moves(dx, dy, step) AS (VALUES (0,-1,10000),(1,-1,14142),(1,0,10000),(1,1,14142),(0,1,10000),(-1,1,14142),(-1,0,10000),(-1,-1,14142))"
ARCS_SQL = "arcs AS (SELECT c.x, c.y, t.x AS x2, t.y AS y2, step AS cost FROM cells c CROSS JOIN moves JOIN cells t ON t.x = c.x+dx AND t.y = c.y+dy JOIN cells a ON a.x = c.x+dx AND a.y = c.y JOIN cells b ON b.x = c.x AND b.y = c.y+dy)"
AROUND_SQL = "around AS (SELECT c.x, c.y, COALESCE(sum(CASE WHEN n.x IS NOT NULL THEN flag END), 0)::BIGINT AS mask FROM cells c CROSS JOIN flags LEFT JOIN cells n ON n.x = c.x+dx AND n.y = c.y+dy GROUP BY 1, 2)"
BASE = f"WITH {D.CELLS_SQL}, {MOVES_SQL}, {FLAGS_SQL}"
POINTS_SQL = "corners(a, b, bit) AS (VALUES (0,0,1),(1,0,2),(0,1,4),(1,1,8)), pts AS (SELECT x+a AS px, y+b AS py, sum(bit)::BIGINT AS mask FROM cells CROSS JOIN corners GROUP BY 1, 2)"


def _forced_sql() -> str:
    parts = []
    for dx, dy in ((0, -1), (0, 1), (1, 0), (-1, 0)):
        flag, ahead, back = G.FLAGS[(dx, dy)], G.FLAGS[(dx, dy)], G.FLAGS[(-dx, -dy)]
        terms = []
        for sx, sy in ((dy, dx), (-dy, -dx)):
            behind, beside, far = G.FLAGS[(sx - dx, sy - dy)], G.FLAGS[(sx, sy)], G.FLAGS[(sx + dx, sy + dy)]
            terms.append(f"CASE WHEN mask & {behind} = 0 AND mask & {beside} > 0 THEN {beside} + CASE WHEN mask & {far} > 0 AND mask & {ahead} > 0 THEN {far} ELSE 0 END ELSE 0 END")
        parts.append(f"SELECT x, y, {flag} AS dir, {' + '.join(terms)} AS forced FROM around WHERE mask & {back} > 0")
    return f"forced AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE forced > 0)"


def _cardinal_sql() -> str:
    parts = []
    for dx, dy in ((0, -1), (0, 1), (1, 0), (-1, 0)):
        line, o = ("y", f"x*{dx}") if dx else ("x", f"y*{dy}")
        runs = f"(SELECT x, y, {line} AS line, {o} AS o, {o} - row_number() OVER (PARTITION BY {line} ORDER BY {o}) AS run FROM cells)"
        parts.append(f"SELECT c.x, c.y, {G.FLAGS[(dx, dy)]} AS dir, min(s.o) - c.o AS steps FROM {runs} c JOIN {runs} s ON s.line = c.line AND s.run = c.run AND s.o > c.o JOIN forced f ON f.x = s.x AND f.y = s.y AND f.dir = {G.FLAGS[(dx, dy)]} GROUP BY c.x, c.y, c.o")
    return f"straight AS ({' UNION ALL '.join(parts)})"


def _diagonal_sql() -> str:
    parts = []
    for dx, dy in ((1, -1), (-1, -1), (1, 1), (-1, 1)):
        line = "x-y" if dx == dy else "x+y"
        both = f"{G.FLAGS[(dx, 0)]}, {G.FLAGS[(0, dy)]}"
        runs = f"(SELECT c.x, c.y, {line.replace('x', 'c.x').replace('y', 'c.y')} AS line, c.x*{dx} AS o, sum(CASE WHEN a.x2 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {line.replace('x', 'c.x').replace('y', 'c.y')} ORDER BY c.x*{dx}) AS run FROM cells c LEFT JOIN arcs a ON a.x2 = c.x AND a.y2 = c.y AND a.x = c.x-({dx}) AND a.y = c.y-({dy}))"
        stops = f"(SELECT DISTINCT x, y FROM straight WHERE dir IN ({both}))"
        parts.append(f"SELECT c.x, c.y, {G.FLAGS[(dx, dy)]} AS dir, min(s.o) - c.o AS steps FROM {runs} c JOIN {runs} s ON s.line = c.line AND s.run = c.run AND s.o > c.o JOIN {stops} t ON t.x = s.x AND t.y = s.y GROUP BY c.x, c.y, c.o")
    return f"diagonal AS ({' UNION ALL '.join(parts)})"


QUERIES = {
    "src02_passable_profiles": lambda s, d: D.grid(s, d).select(F.element_at(F.array(*map(F.lit, "SWT@O.GX")), (F.col("q") % 8 + 1).cast("int")).alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).select("tile", "n", (~F.col("tile").isin(*"SWT@O")).alias("standard"), F.col("tile").isin(*".GS").alias("competition"), (F.col("tile") == ".").alias("only_dots"), F.when(F.col("tile") == "@", 0).otherwise(F.ascii("tile")).cast("long").alias("cost")),
    "src07_scaled_map": lambda s, d: G.scaled(D.cells(s, d), D.SIDE, 48),
    "src08_enlarged_map": lambda s, d: G.enlarged(D.cells(s, d), 3),
    "snk10_map_rows": lambda s, d: G.picture(D.cells(s, d), D.SIDE),
    "jn01_arcs8": lambda s, d: G.arcs(D.cells(s, d)),
    "jn02_arcs_weighted": lambda s, d: G.weighted_arcs(D.weighted_cells(s, d)),
    "jn02_arcs_weighted_strict": lambda s, d: G.weighted_arcs(D.weighted_cells(s, d), strict=True),
    "jn03_arcs4": lambda s, d: G.arcs(D.cells(s, d), diagonals=False),
    "jn03_arcs8_cut": lambda s, d: G.arcs(D.cells(s, d), cut_corners=True),
    "jn04_point_arcs": lambda s, d: G.point_arcs(D.cells(s, d)),
    "jn06_arc_list": lambda s, d: G.arcs(D.cells(s, d), straight=1000, diagonal=1414).select((F.col("y") * D.SIDE + F.col("x")).alias("source"), (F.col("y2") * D.SIDE + F.col("x2")).alias("target"), F.col("cost").alias("weight")),
    "fl01_valid_problems": lambda s, d: G._open_at(G._open_at(D.problems(s, d), D.cells(s, d), ("sx", "sy"), ()), D.cells(s, d), ("gx", "gy"), ()),
    "fl04_corners": lambda s, d: G.points(D.cells(s, d)),
    "fl05_subgoals": lambda s, d: G.subgoals(D.cells(s, d)),
    "fn24_neighbour_masks": lambda s, d: G.around(D.cells(s, d)),
    "pg09_forced_neighbours": lambda s, d: G.forced(D.cells(s, d)),
    "wn06_clearance_left": lambda s, d: G.clearance(D.cells(s, d), 1, 0),
    "wn06_clearance_above": lambda s, d: G.clearance(D.cells(s, d), 0, 1),
    "wn07_clearance_diagonal": lambda s, d: G.clearance(D.cells(s, d), 1, 1),
    "wn08_scan_right": lambda s, d: G.clearance(D.cells(s, d), -1, 0).select("x", "y", (F.col("x") + F.col("clearance")).alias("last_open")),
    "wn09_cardinal_jump": lambda s, d: G.cardinal_jumps(D.cells(s, d)).select("x", "y", "dir", "steps"),
    "pg13_jump_labels": lambda s, d: G.jump_labels(D.cells(s, d)).select("x", "y", "dir", "steps"),
    "pg17_jump_point_arcs": lambda s, d: G.jump_labels(D.cells(s, d)).select("x", "y", "jx", "jy", (F.col("steps") * F.when(F.col("dir") >= 16, G.DIAGONAL).otherwise(G.STRAIGHT)).alias("cost")).distinct(),
    "wn10_entrances": lambda s, d: G.entrances(D.cells(s, d)),
    "st03_direction_union": lambda s, d: G.forced(D.cells(s, d)).groupBy("x", "y").agg(F.bit_or("forced").cast("long").alias("flags")),
    "st05_induced_subgraph": lambda s, d: G.arcs(D.cells(s, d)).where("(x + y) % 3 <> 0 and (x2 + y2) % 3 <> 0"),
}

_J = "x + steps * CASE WHEN dir IN (4,16,64) THEN 1 WHEN dir IN (8,32,128) THEN -1 ELSE 0 END AS jx, y + steps * CASE WHEN dir IN (2,64,128) THEN 1 WHEN dir IN (1,16,32) THEN -1 ELSE 0 END AS jy"
_RUN = "SELECT x, y, row_number() OVER (PARTITION BY line, run ORDER BY o) - 1 AS clearance FROM (SELECT x, y, {line} AS line, {o} AS o, {o} - row_number() OVER (PARTITION BY {line} ORDER BY {o}) AS run FROM cells)"
_W = f"WITH {D.WEIGHTED_SQL}, {MOVES_SQL} SELECT c.x, c.y, t.x AS x2, t.y AS y2, CASE WHEN step = 10000 THEN (c.cost + t.cost) * 10000 // 2 ELSE (c.cost + t.cost + a.cost + b.cost) * 14142 // 4 END AS cost FROM wcells c CROSS JOIN moves JOIN wcells t ON t.x = c.x+dx AND t.y = c.y+dy JOIN wcells a ON a.x = c.x+dx AND a.y = c.y JOIN wcells b ON b.x = c.x AND b.y = c.y+dy"
ORACLES = {
    "src02_passable_profiles": f"WITH {D.GRID_SQL}, t AS (SELECT substr('SWT@O.GX', CAST(q % 8 + 1 AS INT), 1) AS tile FROM h) SELECT tile, count(*) AS n, tile NOT IN ('S','W','T','@','O') AS standard, tile IN ('.','G','S') AS competition, tile = '.' AS only_dots, CASE WHEN tile = '@' THEN 0 ELSE ascii(tile) END AS cost FROM t GROUP BY tile",
    "src07_scaled_map": f"WITH {D.CELLS_SQL} SELECT a.range AS x, b.range AS y FROM range(48) a CROSS JOIN range(48) b JOIN cells c ON c.x = a.range * 32 // 48 AND c.y = b.range * 32 // 48",
    "src08_enlarged_map": f"WITH {D.CELLS_SQL} SELECT x*3 + i.range AS x, y*3 + j.range AS y FROM cells CROSS JOIN range(3) i CROSS JOIN range(3) j",
    "snk10_map_rows": f"WITH {D.CELLS_SQL}, r AS (SELECT DISTINCT y AS ry FROM cells) SELECT ry AS y, string_agg(CASE WHEN c.x IS NULL THEN '@' ELSE '.' END, '' ORDER BY i) AS \"row\" FROM r CROSS JOIN range(32) t(i) LEFT JOIN cells c ON c.y = ry AND c.x = i GROUP BY ry",
    "jn01_arcs8": f"{BASE}, {ARCS_SQL} SELECT * FROM arcs",
    "jn02_arcs_weighted": _W,
    "jn02_arcs_weighted_strict": _W + " WHERE step = 10000 OR (t.cost & a.cost & b.cost) <> 0",
    "jn03_arcs4": f"{BASE}, {ARCS_SQL} SELECT * FROM arcs WHERE cost = 10000",
    "jn03_arcs8_cut": f"{BASE} SELECT c.x, c.y, t.x AS x2, t.y AS y2, step AS cost FROM cells c CROSS JOIN moves JOIN cells t ON t.x = c.x+dx AND t.y = c.y+dy",
    "jn04_point_arcs": f"WITH {D.CELLS_SQL}, {POINTS_SQL}, sides(ax, ay, bx, b_y, cost) AS (VALUES (0,0,1,0,10000),(0,1,1,1,10000),(0,0,0,1,10000),(1,0,1,1,10000),(0,0,1,1,14142),(1,0,0,1,14142)), go AS (SELECT x+ax AS px, y+ay AS py, x+bx AS qx, y+b_y AS qy, cost FROM cells CROSS JOIN sides), b AS (SELECT * FROM go UNION SELECT qx, qy, px, py, cost FROM go) SELECT b.* FROM b JOIN pts USING (px, py) WHERE mask NOT IN (6, 9)",
    "jn06_arc_list": f"{BASE}, {ARCS_SQL} SELECT y*32 + x AS source, y2*32 + x2 AS target, CASE WHEN cost = 10000 THEN 1000 ELSE 1414 END AS weight FROM arcs",
    "fl01_valid_problems": f"WITH {D.CELLS_SQL}, {D.PROBLEMS_SQL} SELECT p.* FROM problems p JOIN cells a ON a.x = sx AND a.y = sy JOIN cells b ON b.x = gx AND b.y = gy",
    "fl04_corners": f"WITH {D.CELLS_SQL}, {POINTS_SQL} SELECT px, py, bit_count(mask) AS n_open, mask IN (7, 11, 13, 14) AS corner, mask IN (6, 9) AS double_corner FROM pts",
    "fl05_subgoals": f"{BASE}, {AROUND_SQL} SELECT x, y FROM around WHERE (mask & 16 = 0 AND mask & 5 = 5) OR (mask & 32 = 0 AND mask & 9 = 9) OR (mask & 64 = 0 AND mask & 6 = 6) OR (mask & 128 = 0 AND mask & 10 = 10)",
    "fn24_neighbour_masks": f"{BASE}, {AROUND_SQL} SELECT * FROM around",
    "pg09_forced_neighbours": f"{BASE}, {AROUND_SQL}, {_forced_sql()} SELECT * FROM forced",
    "wn06_clearance_left": f"WITH {D.CELLS_SQL} " + _RUN.format(line="y", o="x"),
    "wn06_clearance_above": f"WITH {D.CELLS_SQL} " + _RUN.format(line="x", o="y"),
    "wn07_clearance_diagonal": f"WITH {D.CELLS_SQL} " + _RUN.format(line="x-y", o="x"),
    "wn08_scan_right": f"WITH {D.CELLS_SQL} SELECT c.x, c.y, COALESCE((SELECT min(b.i) FROM range(33) b(i) WHERE b.i > c.x AND NOT EXISTS (SELECT 1 FROM cells o WHERE o.x = b.i AND o.y = c.y)), 32) - 1 AS last_open FROM cells c",
    "wn09_cardinal_jump": f"{BASE}, {AROUND_SQL}, {_forced_sql()}, {_cardinal_sql()} SELECT * FROM straight",
    "pg13_jump_labels": f"{BASE}, {ARCS_SQL}, {AROUND_SQL}, {_forced_sql()}, {_cardinal_sql()}, {_diagonal_sql()} SELECT * FROM straight UNION ALL SELECT * FROM diagonal",
    "pg17_jump_point_arcs": f"{BASE}, {ARCS_SQL}, {AROUND_SQL}, {_forced_sql()}, {_cardinal_sql()}, {_diagonal_sql()} SELECT DISTINCT x, y, {_J}, steps * CASE WHEN dir >= 16 THEN 14142 ELSE 10000 END AS cost FROM (SELECT * FROM straight UNION ALL SELECT * FROM diagonal)",
    "wn10_entrances": f"WITH {D.CELLS_SQL}, p AS (SELECT a.x, a.y, a.y - row_number() OVER (PARTITION BY a.x ORDER BY a.y) AS run FROM cells a JOIN cells b ON b.x = a.x+1 AND b.y = a.y WHERE (a.x+1) % 10 = 0), r AS (SELECT x AS border, min(y) AS start, count(*) AS length FROM p GROUP BY x, run) SELECT border, start, length, start + length // 2 AS at FROM r WHERE length < 6 UNION ALL SELECT border, start, length, start FROM r WHERE length >= 6 UNION ALL SELECT border, start, length, start + length - 1 FROM r WHERE length >= 6",
    "st03_direction_union": f"{BASE}, {AROUND_SQL}, {_forced_sql()} SELECT x, y, bit_or(forced) AS flags FROM forced GROUP BY 1, 2",
    "st05_induced_subgraph": f"{BASE}, {ARCS_SQL} SELECT * FROM arcs WHERE (x + y) % 3 <> 0 AND (x2 + y2) % 3 <> 0",
}
