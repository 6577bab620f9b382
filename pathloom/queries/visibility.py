"""Queries for any-angle paths and convex regions, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import intervals as I, mesh_intervals as MI, meshes as M, visibility as V
from ..plans import derived as D


def _points(s, d) -> DataFrame:
    return D.problems(s, d).select("id", ((F.col("sx") * 32 + F.col("gy")) / 32.0).alias("x"), ((F.col("sy") * 32 + F.col("gx")) / 32.0).alias("y"))


def _merged_cells(s, d) -> DataFrame:
    """The cells of the merged boxes of two maps, one of strips and one of single cells: each open cell once. Tests hold
    that no two boxes are left that could be joined."""
    strips, cells = V.rectangles(D.cells(s, d)), D.cells(s, d).selectExpr("x + 100 as x1", "y as y1", "x + 101 as x2", "y + 1 as y2")
    boxes = V.merged(strips.unionByName(cells).withColumn("map", F.when(F.col("x1") >= 100, "squares").otherwise("strips")))
    rows = boxes.select("map", "y1", "y2", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)).alias("x"))
    return rows.select("map", "x", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"))


def _taut_arcs(s, d) -> DataFrame:
    """The arcs between corners on different lines that a taut path may use at both ends."""
    none = D.cells(s, d).select("x", "y").where("x < 0")
    return I.sight_arcs(D.cells(s, d), none, none).where("y <> ty").select("x", "y", "tx", "ty", F.round("length", 6).alias("length"))


def _mesh(s, d) -> DataFrame:
    """The open cells as a mesh of rectangles that meet at parts of their edges."""
    return M.from_boxes(V.rectangles(D.cells(s, d)))


def _fans(s, d) -> DataFrame:
    """Vertices of the mesh where obstacles touch, with the number of fans that its polygons form there."""
    halves = MI.half_edges(MI.oriented(_mesh(s, d)))
    parts = MI.fans(halves, MI.portals(halves))
    return parts.groupBy(*(F.col(c).cast("long").alias(c) for c in "xy")).agg(F.countDistinct("fan").alias("fans"))


def _mesh_arcs(s, d) -> DataFrame:
    """The arcs from corners of the mesh to the nearest corner in a direction, but for those along x, at both ends of which a
    taut path may turn. Cones see what lies behind a corner only where they pass it on one side."""
    none = D.cells(s, d).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x < 0")
    arcs = MI.sight_arcs(_mesh(s, d), none, none)[0].where("y <> ty")
    # quotients of equal fractions of small whole numbers are equal doubles
    nearest = arcs.groupBy("x", "y", F.expr("(tx - x) / (ty - y)").alias("slope"), F.expr("ty > y").alias("up")).agg(F.min(F.struct("length", "tx", "ty", "bent", "ends")).alias("m"))
    return nearest.where("m.bent and m.ends").select(*(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("x", "y", "m.tx", "m.ty")), F.round("m.length", 6).alias("length"))


QUERIES = {
    "pg36_any_angle_length": lambda s, d: V.any_angle(D.cells(s, d), D.problems(s, d)).select("id", F.round("length", 6).alias("length")),
    "pg37_interval_length": lambda s, d: I.interval_lengths(D.cells(s, d), D.problems(s, d)).select("id", F.round("length", 6).alias("length")),
    "fl09_taut_arcs": _taut_arcs,
    "pg40_mesh_length": lambda s, d: MI.interval_lengths(_mesh(s, d), D.problems(s, d)).select("id", F.round("length", 6).alias("length")),
    "pg40_mesh_arcs": _mesh_arcs,
    "jn09_ambiguous_corners": _fans,
    "pg41_any_angle_polyline": lambda s, d: V.any_angle(D.cells(s, d), D.problems(s, d)).select("id", F.posexplode("points").alias("k", "p")).select("id", "k", "p.x", "p.y"),
    "or06_rectangles": lambda s, d: V.rectangles(D.cells(s, d)),
    "or07_merged_boxes": lambda s, d: _merged_cells(s, d),
    "jn08_point_location": lambda s, d: V.located(_points(s, d), V.rectangles(D.cells(s, d))),
    "pg42_rectangle_mesh": lambda s, d: V.neighbours(V.rectangles(D.cells(s, d))),
}
_RECT = D.CELLS_SQL + ", r0 AS (SELECT y, min(x) AS x1, max(x)+1 AS x2 FROM (SELECT x, y, x - row_number() OVER (PARTITION BY y ORDER BY x) AS run FROM cells) GROUP BY y, run), rect AS (SELECT x1, min(y) AS y1, x2, max(y)+1 AS y2 FROM (SELECT *, y - row_number() OVER (PARTITION BY x1, x2 ORDER BY y) AS st FROM r0) GROUP BY x1, x2, st)"
# Sight lines between points by their definition: no blocked cell is crossed, no step leads between two blocked cells, and no
# point is passed where two blocked cells touch corner to corner.
_SIGHT = (
    D.CELLS_SQL + ", pt AS (SELECT x, y, sum(bit)::INT AS near FROM (SELECT x + a AS x, y + b AS y, bit FROM cells CROSS JOIN (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) t(a, b, bit)) GROUP BY 1, 2), co AS (SELECT x, y, CASE WHEN near IN (14, 7) THEN 1 ELSE -1 END AS turn FROM pt WHERE near IN (7, 11, 13, 14)), pinch AS (SELECT x, y FROM pt WHERE near IN (6, 9)), "
    "sq AS (SELECT a.range AS x, b.range AS y FROM range(-1, 33) a CROSS JOIN range(-1, 33) b), bl AS (SELECT x, y FROM sq ANTI JOIN cells USING (x, y)), up AS (SELECT l.x, l.y FROM bl l JOIN bl r ON r.x = l.x - 1 AND r.y = l.y), flat AS (SELECT l.x, l.y FROM bl l JOIN bl r ON r.x = l.x AND r.y = l.y - 1)"
)


def _sees(pairs: str) -> str:
    """The pairs (x, y, tx, ty) that see each other."""
    cross = lambda a, b: f"((tx - q.x) * (bl.y + {b} - q.y) - (ty - q.y) * (bl.x + {a} - q.x))"
    sides = [cross(a, b) for a in (0, 1) for b in (0, 1)]
    inside = " AND ".join(f"least(q.{c}, t{c}) < bl.{c} + 1 AND greatest(q.{c}, t{c}) > bl.{c}" for c in "xy")
    return (
        f"SELECT q.* FROM {pairs} q ANTI JOIN bl ON {inside} AND least({', '.join(sides)}) < 0 AND greatest({', '.join(sides)}) > 0 "
        "ANTI JOIN up ON q.x = tx AND up.x = tx AND up.y >= least(q.y, ty) AND up.y < greatest(q.y, ty) ANTI JOIN flat ON q.y = ty AND flat.y = ty AND flat.x >= least(q.x, tx) AND flat.x < greatest(q.x, tx) "
        "ANTI JOIN pinch ON (pinch.x - q.x) * (ty - q.y) = (pinch.y - q.y) * (tx - q.x) AND pinch.x BETWEEN least(q.x, tx) AND greatest(q.x, tx) AND pinch.y BETWEEN least(q.y, ty) AND greatest(q.y, ty) AND (pinch.x, pinch.y) <> (q.x, q.y) AND (pinch.x, pinch.y) <> (tx, ty)"
    )


_LINE = "sqrt(((tx - x) * (tx - x) + (ty - y) * (ty - y))::DOUBLE)"
_ANY_ANGLE = (
    f"WITH RECURSIVE {_SIGHT}, {D.PROBLEMS_SQL}, ends AS (SELECT sx AS x, sy AS y FROM problems UNION SELECT gx, gy FROM problems UNION SELECT x, y FROM co), p1 AS (SELECT ends.x, ends.y, co.x AS tx, co.y AS ty FROM ends JOIN co ON (ends.x, ends.y) <> (co.x, co.y)), v AS MATERIALIZED ({_sees('p1')}), w AS (SELECT *, {_LINE} AS len FROM v), "
    f"p2 AS (SELECT DISTINCT sx AS x, sy AS y, gx AS tx, gy AS ty FROM problems JOIN pt ON pt.x = sx AND pt.y = sy), v2 AS ({_sees('p2')}), wc AS (SELECT w.* FROM w JOIN co USING (x, y)), st AS (SELECT DISTINCT sx, sy FROM problems), "
    "k(sx, sy, x, y, c) USING KEY (sx, sy, x, y) AS (SELECT sx, sy, tx, ty, len FROM w JOIN st ON x = sx AND y = sy UNION SELECT k.sx, k.sy, wc.tx, wc.ty, min(k.c + wc.len) FROM k JOIN wc ON wc.x = k.x AND wc.y = k.y LEFT JOIN recurring.k r ON r.sx = k.sx AND r.sy = k.sy AND r.x = wc.tx AND r.y = wc.ty WHERE k.c + wc.len < coalesce(r.c, 1e9) - 1e-9 GROUP BY 1, 2, 3, 4), "
    f"g AS (SELECT sx, sy, w.x AS gx, w.y AS gy, c + len AS c FROM (SELECT DISTINCT sx, sy, gx, gy FROM problems) p JOIN w ON w.x = gx AND w.y = gy JOIN k USING (sx, sy) WHERE k.x = w.tx AND k.y = w.ty UNION ALL SELECT x, y, tx, ty, {_LINE} FROM v2 UNION ALL SELECT sx, sy, x, y, c FROM k), m AS (SELECT sx, sy, gx, gy, min(c) AS c FROM g GROUP BY ALL) SELECT id, round(c, 6) AS length FROM problems LEFT JOIN m USING (sx, sy, gx, gy)"
)
ORACLES = {
    "pg36_any_angle_length": _ANY_ANGLE,
    "pg37_interval_length": _ANY_ANGLE,
    "fl09_taut_arcs": f"WITH {_SIGHT}, p AS (SELECT a.x, a.y, b.x AS tx, b.y AS ty FROM co a JOIN co b ON a.y <> b.y AND (b.x - a.x) * (b.y - a.y) * a.turn <= 0 AND (b.x - a.x) * (b.y - a.y) * b.turn <= 0), v AS ({_sees('p')}) SELECT x, y, tx, ty, round({_LINE}, 6) AS length FROM v",
    # On a mesh of rectangles, paths between corners are taut where those on the grid are.
    "pg40_mesh_arcs": f"WITH {_SIGHT}, p AS (SELECT a.x, a.y, b.x AS tx, b.y AS ty FROM co a JOIN co b ON a.y <> b.y AND (b.x - a.x) * (b.y - a.y) * a.turn <= 0 AND (b.x - a.x) * (b.y - a.y) * b.turn <= 0), v AS ({_sees('p')}), o AS (SELECT v.* FROM v ANTI JOIN co ON (co.x - v.x) * (ty - v.y) = (co.y - v.y) * (tx - v.x) AND co.y > least(v.y, ty) AND co.y < greatest(v.y, ty)) SELECT x, y, tx, ty, round({_LINE}, 6) AS length FROM o",
    "pg40_mesh_length": _ANY_ANGLE,
    "jn09_ambiguous_corners": f"WITH {_SIGHT} SELECT x, y, 2::BIGINT AS fans FROM pinch",
    "or06_rectangles": f"WITH {_RECT} SELECT * FROM rect",
    "or07_merged_boxes": f"WITH {D.CELLS_SQL} SELECT m AS map, x + off AS x, y FROM cells CROSS JOIN (VALUES ('strips', 0), ('squares', 100)) t(m, off)",
    "jn08_point_location": f"WITH {_RECT}, {D.PROBLEMS_SQL}, p AS (SELECT id, (sx*32+gy)/32.0::DOUBLE AS x, (sy*32+gx)/32.0::DOUBLE AS y FROM problems) SELECT id, x1, y1, CASE WHEN (x = x1 OR x = x2) AND (y = y1 OR y = y2) THEN 'corner' WHEN x = x1 OR x = x2 OR y = y1 OR y = y2 THEN 'edge' ELSE 'inside' END AS state FROM p JOIN rect ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2",
    "pg42_rectangle_mesh": f"WITH {_RECT}, n AS (SELECT a.x1, a.y1, b.x1 AS ox1, b.y1 AS oy1, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS length FROM rect a JOIN rect b ON a.x2 = b.x1 OR b.x2 = a.x1 UNION ALL SELECT a.x1, a.y1, b.x1, b.y1, least(a.x2, b.x2) - greatest(a.x1, b.x1) FROM rect a JOIN rect b ON a.y2 = b.y1 OR b.y2 = a.y1) SELECT * FROM n WHERE length > 0",
}
