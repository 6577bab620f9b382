"""Queries over abstract graphs of clusters and their entrances, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import abstraction as B, paths as P
from ..plans import derived as D
from . import paths as Q

SIZE = 10


def _refined(s, d) -> DataFrame:
    """The paths refined to moves, each checked against the legal ones."""
    return P.path_costs(B.hierarchical(Q._problems(s, d), D.cells(s, d), (SIZE,)), Q._arcs(s, d)).select("id", "steps", "cost", "valid")


def _edges(s, d) -> DataFrame:
    """The edges of the abstract graph without any problem's ends."""
    return B.levels(D.cells(s, d), Q._problems(s, d).where(F.lit(False)), (SIZE,))[0]


def _per_cluster(s, d) -> DataFrame:
    at = [F.expr(f"source % {P.WIDTH} div {SIZE}").alias("cx"), F.expr(f"source div {P.WIDTH} div {SIZE}").alias("cy")]
    each = _edges(s, d).groupBy(*at).agg(F.count_distinct("source").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return each.agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("nodes"), 6).alias("mean_nodes"), F.round(F.avg("edges"), 6).alias("mean_edges"))


QUERIES = {
    "pg18_hierarchical_paths": _refined,
    "pg18_two_level_cost": lambda s, d: B.hierarchical(Q._problems(s, d), D.cells(s, d), (SIZE, 2 * SIZE)).select("id", "cost"),
    "jn18_cached_paths": lambda s, d: _edges(s, d).select("source", "target", "cost", (F.size("path") - 1).cast("long").alias("steps")),
    "ag22_abstract_edges": _per_cluster,
}


def _crossings_sql() -> str:
    parts = []
    for a, b, at, far in (("x", "y", "{v}*2147483648+x", 1), ("y", "x", "y*2147483648+{v}", 2147483648)):
        name = "ru" if a == "x" else "rl"
        two = f"b.{a} = c.{a}+1 AND b.{b} = c.{b}"
        runs = f"{name} AS (SELECT {a}, min({b}) AS lo, max({b}) AS hi, count(*) AS len FROM (SELECT c.{a}, c.{b}, c.{b} - row_number() OVER (PARTITION BY c.{a} ORDER BY c.{b}) AS run FROM cells c JOIN cells b ON {two} WHERE (c.{a}+1) % {SIZE} = 0) GROUP BY {a}, run)"
        ends = " UNION ALL ".join(f"SELECT {at.format(v=v)} AS f, {at.format(v=v)}+{far} AS t FROM {name} WHERE len {cond}" for v, cond in (("(lo + len // 2)", "< 6"), ("lo", ">= 6"), ("hi", ">= 6")))
        parts.append((runs, ends))
    one = f"one AS ({parts[0][1]} UNION ALL {parts[1][1]})"
    corner = f"SELECT f, t, c FROM arcs WHERE {_CX.format('f')} <> {_CX.format('t')} AND {_CY.format('f')} <> {_CY.format('t')}"
    return f"{parts[0][0]}, {parts[1][0]}, {one}, tr AS (SELECT f, t, 10000 AS c FROM one UNION ALL SELECT t, f, 10000 FROM one UNION ALL {corner})"


_CX, _CY = "({0} % 2147483648 // 10)", "({0} // 2147483648 // 10)"
_SAME = f"{_CX.format('f')} = {_CX.format('t')} AND {_CY.format('f')} = {_CY.format('t')}"
_FAR = Q._FIX.replace("JOIN arcs a", "JOIN inn a")
_GRAPH = f"{Q._R}, {Q._N}, {_crossings_sql()}, inn AS (SELECT * FROM arcs WHERE {_SAME}), nodes AS (SELECT DISTINCT f AS s FROM tr)"
_EDGES = "ab AS (SELECT f, t, c FROM tr UNION ALL SELECT d.s, d.n, cost FROM d JOIN nodes u ON u.s = d.s JOIN nodes v ON v.s = d.n WHERE d.s <> d.n)"
_OPEN = f"{_GRAPH}, src AS (SELECT s FROM nodes), {_FAR}, {_EDGES}"
_UP = "e(s, n, cost) USING KEY (s, n) AS (SELECT d.s, d.n, d.cost FROM d JOIN nodes u ON u.s = d.n WHERE d.s IN (SELECT source FROM pr) UNION SELECT e.s, ab.t, min(e.cost + ab.c) FROM e JOIN ab ON ab.f = e.n LEFT JOIN recurring.e r ON r.s = e.s AND r.n = ab.t WHERE r.cost IS NULL OR e.cost + ab.c < r.cost GROUP BY e.s, ab.t)"
_BEST = "sums AS (SELECT id, e.cost + d.cost AS cost FROM pr JOIN e ON e.s = source JOIN d ON d.s = target AND d.n = e.n UNION ALL SELECT id, cost FROM pr JOIN d ON d.s = source AND d.n = target), hier AS (SELECT id, min(cost)::BIGINT AS cost FROM sums GROUP BY id)"
_HIER = f"{_GRAPH}, {Q._PROB}, src AS (SELECT source AS s FROM pr UNION SELECT target FROM pr UNION SELECT s FROM nodes), {_FAR}, {_EDGES}, {_UP}, {_BEST}"
#: Moves of a path of that cost: cost / 2 = 5000 a + 7071 b, and 4831 is the inverse of 7071 modulo 5000.
_STEPS = "(cost // 2 * 4831 % 5000 + (cost - 14142 * (cost // 2 * 4831 % 5000)) // 10000)::BIGINT"
ORACLES = {
    "pg18_hierarchical_paths": f"{_HIER} SELECT id, {_STEPS} AS steps, cost, true AS valid FROM hier",
    "pg18_two_level_cost": f"{_HIER} SELECT id, cost FROM hier",
    "jn18_cached_paths": f"{_OPEN} SELECT f AS source, t AS target, c::BIGINT AS cost, {_STEPS.replace('cost', 'c')} AS steps FROM ab",
    "ag22_abstract_edges": f"{_OPEN}, k AS (SELECT count(DISTINCT f) AS nodes, count(*) AS edges FROM ab GROUP BY {_CX.format('f')}, {_CY.format('f')}) SELECT count(*) AS clusters, round(avg(nodes), 6) AS mean_nodes, round(avg(edges), 6) AS mean_edges FROM k",
}
