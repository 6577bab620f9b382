"""Path queries over the derived grid and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import grid as G, paths as P
from ..plans import derived as D, search
from . import grid as GQ
from .grid import BASE

W = P.WIDTH


def _problems(s, d) -> DataFrame:
    """(id, source, target) with both ends open."""
    p = D.problems(s, d).select("id", P.node("sx", "sy").alias("source"), P.node("gx", "gy").alias("target"))
    c = D.cells(s, d).select(P.node("x", "y").alias("n"))
    return p.join(c.withColumnRenamed("n", "source"), "source", "left_semi").join(c.withColumnRenamed("n", "target"), "target", "left_semi")


def _arcs(s, d) -> DataFrame:
    return P.numbered(D.cells(s, d))


def _first(s, d) -> DataFrame:
    return D.cells(s, d).agg(F.min(P.node("x", "y")).alias("source"))


def _sssp(s, d, arcs) -> DataFrame:
    return search.single_source(arcs, _first(s, d)).select((F.col("node") % W).alias("x"), F.expr(f"node div {W}").alias("y"), "cost")


def _weighted(s, d) -> DataFrame:
    a = G.weighted_arcs(D.weighted_cells(s, d))
    return a.select(P.node("x", "y").alias("source"), P.node("x2", "y2").alias("target"), "cost")


def _costs(method):
    return lambda s, d: P.solved(_problems(s, d), _arcs(s, d), method).where("cost is not null").select("id", "cost")


def _ch(s, d) -> DataFrame:
    levels, arcs = P.contracted(_arcs(s, d))
    return P.hierarchy_costs(_problems(s, d), levels, arcs)


def _subgoal_nodes(s, d) -> DataFrame:
    return G.subgoals(D.cells(s, d)).select(P.node("x", "y").alias("source"))


def _octile():
    at = [F.col("source") % W, F.expr(f"source div {W}"), F.col("node") % W, F.expr(f"node div {W}")]
    return S.octile(*at)


def _components(s, d) -> DataFrame:
    return search.components(_arcs(s, d), D.cells(s, d).select(P.node("x", "y").alias("node")))


def _landmarks(s, d) -> DataFrame:
    """(landmark, node, cost) from the first and the last open cell."""
    ends = D.cells(s, d).agg(F.min(P.node("x", "y")).alias("a"), F.max(P.node("x", "y")).alias("b")).select(F.explode(F.array("a", "b")).alias("source"))
    return search.single_source(_arcs(s, d), ends).withColumnRenamed("source", "landmark")


def _landmark_bounds(s, d) -> DataFrame:
    t, p = _landmarks(s, d), _problems(s, d)
    j = p.join(t.select("landmark", F.col("node").alias("source"), F.col("cost").alias("a")), "source").join(t.select("landmark", F.col("node").alias("target"), F.col("cost").alias("b")), ["landmark", "target"])
    return j.groupBy("id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("bound"), F.min(F.col("a") + F.col("b")).alias("via_tree"), F.min_by("landmark", F.struct(F.col("a") + F.col("b"), "landmark")).alias("tree"))


def _freespace(s, d) -> DataFrame:
    from ..operators.hierarchies import freespace

    return freespace(_arcs(s, d), _subgoal_nodes(s, d)).where("node <> source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("farthest"))


def _hpa(s, d) -> DataFrame:
    """Cells of each cluster of ten by ten and the arcs that leave it."""
    c = P.clusters(D.cells(s, d))
    a = G.arcs(D.cells(s, d))
    out = a.where("x div 10 <> x2 div 10 or y div 10 <> y2 div 10").groupBy(F.expr("x div 10").alias("cx"), F.expr("y div 10").alias("cy")).agg(F.count(F.lit(1)).alias("leaving"))
    return c.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("cells")).join(out, ["cx", "cy"], "left").select("cx", "cy", "cells", F.coalesce("leaving", F.lit(0)).alias("leaving"))


def _quad(s, d) -> DataFrame:
    """Edges between neighbouring quadrants of four levels, with the number of arcs that cross."""
    a = G.arcs(D.cells(s, d)).withColumn("k", F.explode(F.array(*(F.lit(v) for v in (2, 4, 8, 16)))))
    q = a.selectExpr("k", "x div k as ax", "y div k as ay", "x2 div k as bx", "y2 div k as by").where("ax <> bx or ay <> by")
    return q.groupBy("k", "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("capacity"))


def _refined(s, d) -> DataFrame:
    j = G.jump_labels(D.cells(s, d)).select((P.node("x", "y") * 256 + F.col("dir")).alias("id"), F.lit(0).alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("jx").alias("x2"), F.col("jy").alias("y2"))
    return P.refined(j).groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


QUERIES = {
    "pg03_sssp": lambda s, d: _sssp(s, d, _arcs(s, d)),
    "pg03_sssp_weighted": lambda s, d: _sssp(s, d, _weighted(s, d)),
    "pg03_sssp_corner_cutting": lambda s, d: _sssp(s, d, P.numbered(D.cells(s, d), True)),
    "pg01_scenario_cost": _costs("astar"),
    "pg04_dijkstra_cost": _costs("dijkstra"),
    "pg06_bidirectional_cost": _costs("bidirectional"),
    "pg11_jps_cost": lambda s, d: P.jump_point_costs(D.cells(s, d), D.problems(s, d)).where("cost is not null"),
    "pg14_jump_table_cost": lambda s, d: P.jump_table_costs(D.cells(s, d), D.problems(s, d)).where("cost is not null"),
    "pg07_ch_cost": _ch,
    "pg45_valid_instances": lambda s, d: P.solved(_problems(s, d), _arcs(s, d)).where("cost > 0").select("id").orderBy(F.xxhash64("id")),
    "pg46_optimality_check": lambda s, d: P.solved(_problems(s, d), _arcs(s, d)).where("cost is not null").join(P.jump_point_costs(D.cells(s, d), D.problems(s, d)).withColumnRenamed("cost", "other"), "id").select("id", (F.abs(F.col("cost") - F.col("other")) <= 1000).alias("passed")),
    "fl13_path_validity": lambda s, d: P.path_costs(P.solved(_problems(s, d), _arcs(s, d)), _arcs(s, d)).select("id", "cost", "valid"),
    "pg31_all_pairs_subgoals": lambda s, d: search.single_source(_arcs(s, d), _subgoal_nodes(s, d)).join(_subgoal_nodes(s, d).withColumnRenamed("source", "node"), "node", "left_semi").select("source", "node", "cost"),
    "pg32_freespace_reachable": _freespace,
    "pg43_first_moves": lambda s, d: P.first_moves(_subgoal_nodes(s, d), _arcs(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("targets"), F.sum("move").alias("sum_moves")),
    "wn11_first_move_runs": lambda s, d: P.run_lengths(P.first_moves(_subgoal_nodes(s, d), _arcs(s, d))).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("run_begin").alias("sum_begins")),
    "jn19_landmark_bounds": _landmark_bounds,
    "jn07_undirected_check": lambda s, d: _arcs(s, d).join(_arcs(s, d).select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"], "left_anti").agg(F.count(F.lit(1)).alias("one_way")),
    "ag18_components": _components,
    "ag18_component_sizes": lambda s, d: _components(s, d).groupBy("component").agg(F.count(F.lit(1)).alias("size")),
    "ag19_pathable": lambda s, d: _problems(s, d).join(_components(s, d).toDF("source", "a"), "source").join(_components(s, d).toDF("target", "b"), "target").select("id", (F.col("a") == F.col("b")).alias("pathable")),
    "ag20_degrees": lambda s, d: _arcs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes")),
    "pg18_cluster_sizes": _hpa,
    "pg21_quad_edges": _quad,
    "pg16_refined_jumps": _refined,
    "pg24_relaxed_once": lambda s, d: _landmarks(s, d).join(_arcs(s, d).select(F.col("source").alias("node"), "target", F.col("cost").alias("step")), "node").groupBy("landmark", F.col("target").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("cost")),
    "pg38_point_sssp": lambda s, d: search.single_source((a := G.point_arcs(D.cells(s, d)).select(P.node("px", "py").alias("source"), P.node("qx", "qy").alias("target"), "cost")), a.agg(F.min("source").alias("source"))).select("node", "cost"),
}

_N = "arcs AS (SELECT c.y*2147483648+c.x AS f, t.y*2147483648+t.x AS t, step AS c FROM cells c CROSS JOIN moves JOIN cells t ON t.x = c.x+dx AND t.y = c.y+dy JOIN cells a ON a.x = c.x+dx AND a.y = c.y JOIN cells b ON b.x = c.x AND b.y = c.y+dy)"
_FIX = "d(s, n, cost) USING KEY (s, n) AS (SELECT s, s, 0::BIGINT FROM src UNION SELECT d.s, a.t, min(d.cost + a.c) FROM d JOIN arcs a ON a.f = d.n LEFT JOIN recurring.d r ON r.s = d.s AND r.n = a.t WHERE r.cost IS NULL OR d.cost + a.c < r.cost GROUP BY d.s, a.t)"
_R = BASE.replace("WITH ", "WITH RECURSIVE ", 1)
_FIRST = "src AS (SELECT min(y*2147483648+x) AS s FROM cells)"
_PROB = f"{D.PROBLEMS_SQL}, pr AS (SELECT id, sy*2147483648+sx AS source, gy*2147483648+gx AS target FROM problems p JOIN cells a ON a.x = sx AND a.y = sy JOIN cells b ON b.x = gx AND b.y = gy)"
_PSRC = "src AS (SELECT DISTINCT source AS s FROM pr)"
_COST = f"{_R}, {_N}, {_PROB}, {_PSRC}, {_FIX} SELECT id, cost FROM pr JOIN d ON d.s = source AND d.n = target"
_XY = "SELECT n % 2147483648 AS x, n // 2147483648 AS y, cost FROM d"
_CUT = _N.replace(" JOIN cells a ON a.x = c.x+dx AND a.y = c.y JOIN cells b ON b.x = c.x AND b.y = c.y+dy", "")
_SUB = "sub AS (SELECT c.x, c.y, sum(CASE WHEN n.x IS NOT NULL THEN flag ELSE 0 END)::BIGINT AS mask FROM cells c CROSS JOIN flags LEFT JOIN cells n ON n.x = c.x+dx AND n.y = c.y+dy GROUP BY 1, 2), src AS (SELECT y*2147483648+x AS s FROM sub WHERE (mask & 16 = 0 AND mask & 5 = 5) OR (mask & 32 = 0 AND mask & 9 = 9) OR (mask & 64 = 0 AND mask & 6 = 6) OR (mask & 128 = 0 AND mask & 10 = 10))"
_COMP = "k(n, c) USING KEY (n) AS (SELECT y*2147483648+x, y*2147483648+x FROM cells UNION SELECT a.t, min(k.c) FROM k JOIN arcs a ON a.f = k.n JOIN recurring.k r ON r.n = a.t WHERE k.c < r.c GROUP BY a.t)"
_LAND = "src AS (SELECT min(y*2147483648+x) AS s FROM cells UNION SELECT max(y*2147483648+x) FROM cells)"
_FM = f"{_R}, {_N}, {_SUB}, {_FIX}, fm(s, n, mv) USING KEY (s, n) AS (SELECT a.f, a.t, a.t FROM arcs a JOIN src ON src.s = a.f JOIN d ON d.s = a.f AND d.n = a.t AND d.cost = a.c UNION SELECT fm.s, a.t, min(fm.mv) FROM fm JOIN d p ON p.s = fm.s AND p.n = fm.n JOIN arcs a ON a.f = fm.n JOIN d q ON q.s = fm.s AND q.n = a.t AND q.cost = p.cost + a.c LEFT JOIN recurring.fm r ON r.s = fm.s AND r.n = a.t WHERE r.mv IS NULL OR fm.mv < r.mv GROUP BY fm.s, a.t)"
_WA = "moves(dx, dy, step) AS (VALUES (0,-1,10000),(1,-1,14142),(1,0,10000),(1,1,14142),(0,1,10000),(-1,1,14142),(-1,0,10000),(-1,-1,14142)), arcs AS (SELECT c.y*2147483648+c.x AS f, t.y*2147483648+t.x AS t, CASE WHEN step = 10000 THEN (c.cost+t.cost)*10000//2 ELSE (c.cost+t.cost+a.cost+b.cost)*14142//4 END AS c FROM wcells c CROSS JOIN moves JOIN wcells t ON t.x = c.x+dx AND t.y = c.y+dy JOIN wcells a ON a.x = c.x+dx AND a.y = c.y JOIN wcells b ON b.x = c.x AND b.y = c.y+dy), src AS (SELECT min(y*2147483648+x) AS s FROM wcells)"
ORACLES = {
    "pg03_sssp": f"{_R}, {_N}, {_FIRST}, {_FIX} {_XY}",
    "pg03_sssp_weighted": f"WITH RECURSIVE {D.WEIGHTED_SQL}, {_WA}, {_FIX} {_XY}",
    "pg03_sssp_corner_cutting": f"{_R}, {_CUT}, {_FIRST}, {_FIX} {_XY}",
    **{k: _COST for k in ("pg01_scenario_cost", "pg04_dijkstra_cost", "pg06_bidirectional_cost", "pg11_jps_cost", "pg14_jump_table_cost", "pg07_ch_cost")},
    "pg45_valid_instances": _COST.replace("SELECT id, cost FROM pr", "SELECT id FROM pr") + " WHERE cost > 0",
    "pg46_optimality_check": _COST.replace("SELECT id, cost FROM pr", "SELECT id, true AS passed FROM pr"),
    "fl13_path_validity": _COST.replace("SELECT id, cost FROM pr", "SELECT id, cost, true AS valid FROM pr"),
    "pg31_all_pairs_subgoals": f"{_R}, {_N}, {_SUB}, {_FIX} SELECT d.s AS source, n AS node, cost FROM d JOIN src ON src.s = d.n",
    "pg32_freespace_reachable": f"{_R}, {_N}, {_SUB}, {_FIX}, o AS (SELECT *, abs(s%2147483648 - n%2147483648) AS ax, abs(s//2147483648 - n//2147483648) AS ay FROM d) SELECT s AS source, count(*) AS n, max(cost) AS farthest FROM o WHERE cost = least(ax,ay)*14142 + (greatest(ax,ay)-least(ax,ay))*10000 AND s <> n GROUP BY s",
    "pg43_first_moves": f"{_FM} SELECT s AS source, count(*) AS targets, sum(mv)::BIGINT AS sum_moves FROM fm WHERE s <> n GROUP BY s",
    "wn11_first_move_runs": f"{_FM}, z AS (SELECT *, lag(mv) OVER (PARTITION BY s ORDER BY n) AS p FROM fm WHERE s <> n) SELECT s AS source, count(*) AS runs, sum(n)::BIGINT AS sum_begins FROM z WHERE p IS NULL OR p <> mv GROUP BY s",
    "jn19_landmark_bounds": f"{_R}, {_N}, {_LAND}, {_FIX}, {_PROB} SELECT id, max(abs(a.cost-b.cost)) AS bound, min(a.cost+b.cost) AS via_tree, arg_min(a.s, struct_pack(c := a.cost+b.cost, l := a.s)) AS tree FROM pr JOIN d a ON a.n = source JOIN d b ON b.n = target AND a.s = b.s GROUP BY id",
    "jn07_undirected_check": f"{BASE}, {_N} SELECT count(*) AS one_way FROM arcs a WHERE NOT EXISTS (SELECT 1 FROM arcs b WHERE b.f = a.t AND b.t = a.f)",
    "ag18_components": f"{_R}, {_N}, {_COMP} SELECT n AS node, c AS component FROM k",
    "ag18_component_sizes": f"{_R}, {_N}, {_COMP} SELECT c AS component, count(*) AS size FROM k GROUP BY c",
    "ag19_pathable": f"{_R}, {_N}, {_COMP}, {_PROB} SELECT id, a.c = b.c AS pathable FROM pr JOIN k a ON a.n = source JOIN k b ON b.n = target",
    "ag20_degrees": f"{BASE}, {_N}, g AS (SELECT f, count(*) AS degree FROM arcs GROUP BY f) SELECT degree, count(*) AS nodes FROM g GROUP BY degree",
    "pg18_cluster_sizes": f"{BASE}, {_N}, o AS (SELECT f%2147483648//10 AS cx, f//2147483648//10 AS cy, count(*) AS leaving FROM arcs WHERE f%2147483648//10 <> t%2147483648//10 OR f//2147483648//10 <> t//2147483648//10 GROUP BY 1, 2), c AS (SELECT x//10 AS cx, y//10 AS cy, count(*) AS cells FROM cells GROUP BY 1, 2) SELECT cx, cy, cells, COALESCE(leaving, 0) AS leaving FROM c LEFT JOIN o USING (cx, cy)",
    "pg21_quad_edges": f"{BASE}, {_N}, ks(k) AS (VALUES (2),(4),(8),(16)), q AS (SELECT k, f%2147483648//k AS ax, f//2147483648//k AS ay, t%2147483648//k AS bx, t//2147483648//k AS \"by\" FROM arcs CROSS JOIN ks) SELECT k, ax, ay, bx, \"by\", count(*) AS capacity FROM q WHERE ax <> bx OR ay <> \"by\" GROUP BY ALL",
    "pg24_relaxed_once": f"{_R}, {_N}, {_LAND}, {_FIX} SELECT s AS landmark, t AS node, min(cost + c) AS cost FROM d JOIN arcs ON f = n GROUP BY 1, 2",
    "pg38_point_sssp": GQ.ORACLES["jn04_point_arcs"].replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT b.* FROM b", f", pa AS (SELECT b.* FROM b", 1) + f"), arcs AS (SELECT py*2147483648+px AS f, qy*2147483648+qx AS t, cost AS c FROM pa), src AS (SELECT min(f) AS s FROM arcs), {_FIX} SELECT n AS node, cost FROM d",
    "pg16_refined_jumps": "SELECT (y*2147483648+x)*256+dir AS id, steps+1 AS points, (x*(steps+1) + sx*(steps*(steps+1)//2))::BIGINT AS sum_x, (y*(steps+1) + sy*(steps*(steps+1)//2))::BIGINT AS sum_y FROM (SELECT *, CASE WHEN dir IN (4,16,64) THEN 1 WHEN dir IN (8,32,128) THEN -1 ELSE 0 END AS sx, CASE WHEN dir IN (2,64,128) THEN 1 WHEN dir IN (1,16,32) THEN -1 ELSE 0 END AS sy FROM (" + GQ.ORACLES["pg13_jump_labels"] + "))",
}
