"""Queries over reduced graphs, followed moves and generated problems, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import contraction as R, graphs as H, grid as G, hierarchies as K, paths as P, visibility as V
from ..plans import derived as D, search, strategies
from . import grid as GQ, paths as Q
from .grid import BASE
from .paths import _COST, _CUT, _FIRST, _FIX, _FM, _N, _PROB, _R, _SUB
from .visibility import _RECT


def _unpacked_cost(s, d) -> DataFrame:
    levels, arcs = P.contracted(Q._arcs(s, d))
    return P.hierarchy_costs(Q._problems(s, d), levels, H.unpacked(arcs))


def _rsr(s, d) -> DataFrame:
    far = search.single_source(K.rectangle_graph(D.cells(s, d)), Q._first(s, d))
    return far.select((F.col("node") % P.WIDTH).alias("x"), F.expr(f"node div {P.WIDTH}").alias("y"), "cost")


def _table(s, d) -> DataFrame:
    """The first moves of all open cells, as run lengths."""
    return P.run_lengths(P.first_moves(D.cells(s, d).select(P.node("x", "y").alias("source")), Q._arcs(s, d)))


def _followed(s, d) -> DataFrame:
    return K.followed(Q._problems(s, d), _table(s, d), Q._arcs(s, d)).select("id", "cost")


def _refined_legs(s, d) -> DataFrame:
    """Paths over subgoals refined: the unit moves of each leg are followed and their costs summed."""
    found = search.scratch(K.subgoal_costs(Q._problems(s, d), Q._subgoal_nodes(s, d), Q._arcs(s, d)).where("cost is not null").select("id", "path"))
    legs = found.select("id", F.posexplode(F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("source"), b.alias("target")))).alias("k", "leg"))
    legs = search.scratch(legs.select(F.col("id").alias("path"), "leg.source", "leg.target"))
    each = K.followed(legs.select("source", "target").distinct().select(F.struct("source", "target").alias("id"), "source", "target"), _table(s, d), Q._arcs(s, d))
    each = legs.join(each.select("id.source", "id.target", "cost"), ["source", "target"]).groupBy("path").agg(F.sum("cost").alias("cost"))
    return found.select(F.col("id").alias("path")).join(each, "path", "left").select(F.col("path").alias("id"), F.coalesce("cost", F.lit(0)).alias("cost"))


def _halves(s, d) -> DataFrame:
    """Run-length rows of two sets of sources, one after the other."""
    sub = Q._subgoal_nodes(s, d)
    parts = [P.run_lengths(P.first_moves(sub.where(F.col("source") % 2 == k), Q._arcs(s, d))) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum("run_begin").alias("sum_begins"))


def _avoidable(s, d) -> DataFrame:
    """Arcs that need not be taken: those into subgoals may be left out, but for the exceptions, straight moves to the east."""
    arcs, sub = Q._arcs(s, d), Q._subgoal_nodes(s, d).withColumnRenamed("source", "target")
    kept = arcs.join(sub, "target", "left_anti").unionByName(arcs.join(sub, "target", "left_semi").where("target - source = 1").select("target", "source", "cost"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _edge_cache(s, d) -> DataFrame:
    """Cached numbers of cells of the jumps to the east and west, looked up for all problems' starts."""
    cache = G.jump_labels(D.cells(s, d)).where("dir in (4, 8)").select(F.col("x").alias("sx"), F.col("y").alias("sy"), "dir", (F.col("steps") + 1).alias("points"))
    asked = D.problems(s, d).select("id", "sx", "sy", F.when(F.col("gx") >= F.col("sx"), 4).otherwise(8).alias("dir"))
    return asked.join(cache, ["sx", "sy", "dir"], "left").select("id", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def _mapped_heuristic(s, d) -> DataFrame:
    """Octile distances of subgoals that follow each other, asked by their dense ids."""
    ids = G.ranked(Q._subgoal_nodes(s, d).withColumnRenamed("source", "node"))
    after = ids.select((F.col("rank") - 1).alias("rank"), F.col("node").alias("other"))
    return ids.join(after, "rank").select("rank", K._straight("node", "other").cast("long").alias("h"))


def _pruned(s, d) -> DataFrame:
    """Cells inside rectangles, which the reduced graph leaves out, and the moves between rectangles, per rectangle."""
    boxes = V.rectangles(D.cells(s, d))
    size = boxes.select(F.struct("x1", "y1").alias("pid"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("cells"))
    edge = K.perimeters(boxes).groupBy("pid").agg(F.count(F.lit(1)).alias("kept"))
    return size.join(edge, "pid").agg(F.round(F.avg("cells"), 6).alias("mean_size"), F.round(F.avg(F.col("cells") - F.col("kept")), 6).alias("mean_pruned"), F.sum("kept").alias("nodes"))


QUERIES = {
    "pg02_weighted_astar_cost": lambda s, d: P.solved(Q._problems(s, d), Q._weighted(s, d), "astar", scale=46).where("cost is not null").select("id", "cost"),
    "pg18_cluster_cost": lambda s, d: K.cluster_costs(Q._problems(s, d), D.cells(s, d)).where("cost is not null"),
    "pg20_rectangle_cost": _rsr,
    "pg25_unpacked_hierarchy_cost": _unpacked_cost,
    "pg26_level_cost": lambda s, d: R.level_costs(Q._problems(s, d), Q._subgoal_nodes(s, d), Q._arcs(s, d), most=5),
    "pg33_h_reachable": lambda s, d: K.h_reachable(Q._problems(s, d), Q._arcs(s, d)),
    "pg34_subgoal_cost": lambda s, d: K.subgoal_costs(Q._problems(s, d), Q._subgoal_nodes(s, d), Q._arcs(s, d)).where("cost is not null").select("id", "cost"),
    "pg34_refined_legs": _refined_legs,
    "pg05_graph_search_cost": lambda s, d: P.solved(Q._problems(s, d), Q._arcs(s, d), "astar", scale=0).where("cost is not null").select("id", "cost"),
    "pg44_followed_cost": lambda s, d: _followed(s, d),
    "pg45_generated_problems": lambda s, d: K.generated(D.cells(s, d), Q._arcs(s, d), 2000),
    "plugin_costs": lambda s, d: strategies.compared(Q._problems(s, d), D.cells(s, d)),
    "st04_joined_rows": _halves,
    "fl14_avoidable_with_exceptions": _avoidable,
    "jn18_cached_edges": _edge_cache,
    "fn09_mapped_heuristic": _mapped_heuristic,
    "ag22_pruned_nodes": _pruned,
    "ag21_node_ratios": lambda s, d: D.cells(s, d).withColumn("k", F.explode(F.array(*map(F.lit, (2, 4, 8, 16))))).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.expr("x div k"), F.expr("y div k")).alias("up")).select("k", F.round(F.col("up") / F.col("n"), 6).alias("ratio")),
}
_BOX = _RECT[len(D.CELLS_SQL) + 2 :]
_EDGE = "EXISTS (SELECT 1 FROM rect r WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 AND (x = x1 OR x = x2-1 OR y = y1 OR y = y2-1))"
_OCT2 = "least(abs({a}%2147483648 - {b}%2147483648), abs({a}//2147483648 - {b}//2147483648))*14142 + (greatest(abs({a}%2147483648 - {b}%2147483648), abs({a}//2147483648 - {b}//2147483648)) - least(abs({a}%2147483648 - {b}%2147483648), abs({a}//2147483648 - {b}//2147483648)))*10000"
_RANKED = "rk AS (SELECT y*2147483648+x AS node, row_number() OVER (ORDER BY y*2147483648+x) - 1 AS rank FROM cells)"
ORACLES = {
    "pg02_weighted_astar_cost": f"WITH RECURSIVE {D.WEIGHTED_SQL}, {Q._WA.rsplit(', src AS', 1)[0]}, {_PROB.replace('cells', 'wcells')}, {Q._PSRC}, {_FIX} SELECT id, cost FROM pr JOIN d ON d.s = source AND d.n = target",
    **{k: _COST for k in ("pg18_cluster_cost", "pg25_unpacked_hierarchy_cost", "pg26_level_cost", "pg34_subgoal_cost", "pg34_refined_legs", "pg05_graph_search_cost", "pg44_followed_cost")},
    "pg20_rectangle_cost": f"{_R}, {_BOX}, {_CUT}, {_FIRST}, {_FIX} SELECT x, y, cost FROM (SELECT n % 2147483648 AS x, n // 2147483648 AS y, cost FROM d) WHERE {_EDGE}",
    "pg33_h_reachable": f"{_R}, {_N}, {_PROB}, {Q._PSRC}, {_FIX} SELECT id, COALESCE(cost = {_OCT2.format(a='source', b='target')}, false) AS reachable FROM pr LEFT JOIN d ON d.s = source AND d.n = target",
    "pg45_generated_problems": f"{_R}, {_N}, {_RANKED}, k AS (SELECT count(*) AS n FROM cells), pairs AS (SELECT i AS id, a.node AS source, b.node AS target FROM range(2000) t(i) CROSS JOIN k JOIN rk a ON a.rank = i*7919 % n JOIN rk b ON b.rank = (i*104729 + 13) % n WHERE a.node <> b.node), src AS (SELECT DISTINCT source AS s FROM pairs), {_FIX} SELECT id, source, target, cost FROM pairs JOIN d ON d.s = source AND d.n = target",
    "plugin_costs": _COST.replace("SELECT id, cost FROM pr", "SELECT algorithm, id, cost FROM (VALUES ('astar'), ('clusters'), ('jumps'), ('subgoals')) g(algorithm) CROSS JOIN pr"),
    "st04_joined_rows": Q.ORACLES["wn11_first_move_runs"],
    "fl14_avoidable_with_exceptions": f"{BASE}, {_N}, {_SUB} SELECT f AS source, count(*) AS n FROM arcs WHERE t NOT IN (SELECT s FROM src) OR t - f = 1 GROUP BY f",
    "jn18_cached_edges": f"WITH jl AS ({GQ.ORACLES['pg13_jump_labels']}), {D.PROBLEMS_SQL} SELECT id, COALESCE(steps + 1, 0)::BIGINT AS points FROM problems LEFT JOIN jl ON x = sx AND y = sy AND dir = CASE WHEN gx >= sx THEN 4 ELSE 8 END",
    "fn09_mapped_heuristic": f"{BASE}, {_SUB}, k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS rank, lead(s) OVER (ORDER BY s) AS o FROM src) SELECT rank, ({_OCT2.format(a='s', b='o')})::BIGINT AS h FROM k WHERE o IS NOT NULL",
    "ag22_pruned_nodes": f"WITH {_RECT}, c AS (SELECT x1, y1, count(*) AS cells, count(*) FILTER (x = x1 OR x = x2-1 OR y = y1 OR y = y2-1) AS kept FROM rect JOIN cells ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY x1, y1) SELECT round(avg(cells), 6) AS mean_size, round(avg(cells - kept), 6) AS mean_pruned, sum(kept)::BIGINT AS nodes FROM c",
    "ag21_node_ratios": f"WITH {D.CELLS_SQL} SELECT k, round(count(DISTINCT (x//k, y//k))/count(*), 6) AS ratio FROM cells CROSS JOIN (VALUES (2),(4),(8),(16)) t(k) GROUP BY k",
}
