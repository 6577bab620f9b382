"""Queries over graphs and meshes, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import analytics as A, graphs as H, grid as G, meshes as M, paths as P, visibility as V
from ..plans import derived as D, search
from . import paths as Q
from .grid import BASE
from .paths import _FIX, _N, _PROB, _R, _SUB
from .visibility import _RECT


def _pairs(s, d) -> DataFrame:
    n = V.neighbours(V.rectangles(D.cells(s, d)))
    return n.select((F.col("y1") * 2147483648 + F.col("x1")).alias("a"), (F.col("oy1") * 2147483648 + F.col("ox1")).alias("b"))


def _mesh_length(s, d) -> DataFrame:
    c = D.cells(s, d)
    corners = G.points(c).where("corner").select(F.col("px").alias("x"), F.col("py").alias("y"))
    return M.mesh_paths(M.from_boxes(V.rectangles(c)), _pairs(s, d), corners, D.problems(s, d)).select("id", F.round("length", 6).alias("length"))


def _directed(s, d) -> DataFrame:
    l = D.table(s, d, "lineitem")
    return l.select((F.col("l_partkey") % 300).alias("source"), (F.col("l_suppkey") * 7 % 300).alias("target")).distinct()


def _hpa_arcs(s, d) -> DataFrame:
    return G.arcs(D.cells(s, d)).where("x div 10 = 1 or x2 div 10 = 1")


def _lattice(s, d) -> DataFrame:
    prim = s.sql("select * from values (0L,0L,2L,0L,20000L,array(struct(1L as dx,0L as dy),struct(2L as dx,0L as dy))), (0L,1L,2L,1L,22000L,array(struct(1L as dx,0L as dy),struct(2L as dx,0L as dy),struct(2L as dx,1L as dy))), (1L,1L,0L,2L,20000L,array(struct(0L as dx,1L as dy),struct(0L as dx,2L as dy))) as t(o,o2,dx,dy,cost,swept)")
    return H.lattice_arcs(D.cells(s, d), prim)


def _subgoal_arcs(s, d) -> DataFrame:
    sub = Q._subgoal_nodes(s, d)
    return H.connected_to(sub, sub, Q._arcs(s, d)).where("source <> subgoal").select("source", F.col("subgoal").alias("target"), "cost")


QUERIES = {
    "jn05_incident_edges": lambda s, d: Q._arcs(s, d).join(Q._first(s, d), "source").select("source", "target", "cost"),
    "jn15_connected_subgoals": lambda s, d: H.connected_to(Q._problems(s, d).select("source"), Q._subgoal_nodes(s, d), Q._arcs(s, d)),
    "jn16_dense_ids": lambda s, d: A.running_count(Q._subgoal_nodes(s, d), "source", F.lit(True), "n", 1 << 18).select("source", (F.col("n") - 1).alias("id")),
    "fl02_search_parameters": lambda s, d: Q._problems(s, d).where("source <> target").select("id"),
    "fl06_point_in_polygon": lambda s, d: M.classified(D.problems(s, d).select("id", (F.col("sx") + F.col("gy") / 32.0).alias("x"), (F.col("sy") + F.col("gx") / 32.0).alias("y")), M.from_boxes(V.rectangles(D.cells(s, d)))),
    "fl08_corridor": lambda s, d: _hpa_arcs(s, d),
    "fl14_avoidable": lambda s, d: Q._arcs(s, d).join(G.subgoals(D.cells(s, d)).select(P.node("x", "y").alias("target")), "target", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "ag07_apply_per_group": lambda s, d: A.applied(D.measurements(s, d).select("alg", "time"), "alg", "time", lambda v: float(v.max() - v.min())).select("alg", F.round("value", 6).alias("spread")),
    "ag18_strong_components": lambda s, d: H.strong_components(_directed(s, d).withColumn("cost", F.lit(1))),
    "ag21_width_bfs": lambda s, d: search.single_source(H.unit_arcs(D.cells(s, d)), Q._first(s, d)).groupBy(F.col("cost").alias("hops")).agg(F.count(F.lit(1)).alias("width")),
    "ag22_cluster_means": lambda s, d: P.clusters(D.cells(s, d)).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_size"), F.count(F.lit(1)).alias("clusters")),
    "or08_node_orders": lambda s, d: Q._subgoal_nodes(s, d).select("source", F.md5(F.col("source").cast("string").cast("binary")).alias("k")).orderBy("k"),
    "pg30_irredundant_arcs": lambda s, d: H.irredundant(_subgoal_arcs(s, d)),
    "pg35_lattice_arcs": _lattice,
    "pg19_corridor_costs": lambda s, d: search.single_source(P.numbered(D.cells(s, d).where("x between 5 and 20")), D.cells(s, d).where("x between 5 and 20").agg(F.min(P.node("x", "y")).alias("source"))).select("node", "cost"),
    "pg39_mesh_length": _mesh_length,
    "ra_relaxed_cost": lambda s, d: H.relaxed_costs(Q._problems(s, d), Q._arcs(s, d)).where("cost is not null"),
}
_SUBSET = BASE.replace("q % 4 <> 0)", "q % 4 <> 0 AND x BETWEEN 5 AND 20)", 1).replace("WITH ", "WITH RECURSIVE ", 1)
_OCT = "least(abs(s%2147483648 - n%2147483648), abs(s//2147483648 - n//2147483648))*14142 + (greatest(abs(s%2147483648 - n%2147483648), abs(s//2147483648 - n//2147483648)) - least(abs(s%2147483648 - n%2147483648), abs(s//2147483648 - n//2147483648)))*10000"
_SG = _SUB.replace("src AS", "sg AS")
ORACLES = {
    "jn05_incident_edges": f"{BASE}, {_N} SELECT f AS source, t AS target, c AS cost FROM arcs WHERE f = (SELECT min(y*2147483648+x) FROM cells)",
    "jn15_connected_subgoals": f"{_R}, {_N}, {_SG}, {_PROB}, src AS (SELECT DISTINCT source AS s FROM pr), {_FIX} SELECT d.s AS source, n AS subgoal, cost FROM d JOIN sg ON sg.s = n WHERE cost = {_OCT.replace('s%', 'd.s%').replace('s//', 'd.s//')}",
    "jn16_dense_ids": f"{BASE}, {_SUB} SELECT s AS source, row_number() OVER (ORDER BY s) - 1 AS id FROM src",
    "fl02_search_parameters": f"{BASE}, {_PROB} SELECT id FROM pr WHERE source <> target",
    "fl06_point_in_polygon": f"WITH {_RECT}, {D.PROBLEMS_SQL}, p AS (SELECT id, sx + gy/32.0::DOUBLE AS x, sy + gx/32.0::DOUBLE AS y FROM problems) SELECT id, y1*2147483648+x1 AS pid, CASE WHEN (x = x1 OR x = x2) AND (y = y1 OR y = y2) THEN 'vertex' WHEN x = x1 OR x = x2 OR y = y1 OR y = y2 THEN 'edge' ELSE 'inside' END AS state FROM p JOIN rect ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2",
    "fl08_corridor": f"{BASE}, {_N} SELECT f%2147483648 AS x, f//2147483648 AS y, t%2147483648 AS x2, t//2147483648 AS y2, c AS cost FROM arcs WHERE f%2147483648//10 = 1 OR t%2147483648//10 = 1",
    "fl14_avoidable": f"{BASE}, {_N}, {_SUB} SELECT f AS source, count(*) AS n FROM arcs WHERE t NOT IN (SELECT s FROM src) GROUP BY f",
    "ag07_apply_per_group": f"WITH {D.MEASUREMENTS_SQL} SELECT alg, round(max(time) - min(time), 6) AS spread FROM m GROUP BY alg",
    "ag18_strong_components": "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 300 AS f, l_suppkey * 7 % 300 AS t FROM lineitem), n AS (SELECT f AS n FROM e UNION SELECT t FROM e), r(a, b) AS (SELECT n, n FROM n UNION SELECT r.a, e.t FROM r JOIN e ON e.f = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "ag21_width_bfs": f"{_R}, {_N.replace('step AS c', '1 AS c')}, {Q._FIRST}, {_FIX} SELECT cost AS hops, count(*) AS width FROM d GROUP BY cost",
    "ag22_cluster_means": f"WITH {D.CELLS_SQL}, g AS (SELECT x//10, y//10, count(*) AS n FROM cells GROUP BY 1, 2) SELECT round(avg(n), 6) AS mean_size, count(*) AS clusters FROM g",
    "or08_node_orders": f"{BASE}, {_SUB} SELECT s AS source, md5(s::VARCHAR) AS k FROM src ORDER BY k",
    "pg30_irredundant_arcs": f"{_R}, {_N}, {_SUB}, {_FIX}, a AS (SELECT s, n, cost FROM d WHERE n IN (SELECT s FROM src) AND s <> n AND cost = {_OCT}) SELECT a.s AS source, a.n AS target, a.cost FROM a LEFT JOIN (SELECT p.s, q.n, min(p.cost + q.cost) AS c FROM a p JOIN a q ON p.n = q.s GROUP BY 1, 2) z ON z.s = a.s AND z.n = a.n WHERE z.c IS NULL OR z.c > a.cost",
    "pg35_lattice_arcs": f"WITH {D.CELLS_SQL} SELECT c.x, c.y, 0 AS o, c.x+2 AS x2, c.y AS y2, 0 AS o2, 20000 AS cost FROM cells c JOIN cells a ON a.x = c.x+1 AND a.y = c.y JOIN cells b ON b.x = c.x+2 AND b.y = c.y UNION ALL SELECT c.x, c.y, 0, c.x+2, c.y+1, 1, 22000 FROM cells c JOIN cells a ON a.x = c.x+1 AND a.y = c.y JOIN cells b ON b.x = c.x+2 AND b.y = c.y JOIN cells e ON e.x = c.x+2 AND e.y = c.y+1 UNION ALL SELECT c.x, c.y, 1, c.x, c.y+2, 1, 20000 FROM cells c JOIN cells a ON a.x = c.x AND a.y = c.y+1 JOIN cells b ON b.x = c.x AND b.y = c.y+2",
    "pg19_corridor_costs": f"{_SUBSET}, {_N}, {Q._FIRST}, {_FIX} SELECT n AS node, cost FROM d",
}
