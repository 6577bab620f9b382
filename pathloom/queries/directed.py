"""Queries over cells with directions of arrival, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import directed as E
from ..plans import derived as D
from .grid import ARCS_SQL, BASE
from .paths import ORACLES as _PATHS, _FIRST, _N, _R


def _turns(s, d) -> DataFrame:
    cells = D.cells(s, d)
    first = cells.agg(F.min(F.struct("y", "x")).alias("m")).select(F.col("m.x").alias("sx"), F.col("m.y").alias("sy"))
    return E.fewest_turns(cells, first).select("x", "y", "cost", "turns")


def _sizes(s, d) -> DataFrame:
    """Moves that follow each move, in all and in the canonical graph."""
    count = lambda canonical, name: E.successions(D.cells(s, d), canonical).groupBy("dx", "dy").agg(F.count(F.lit(1)).alias(name))
    return count(False, "successors").join(count(True, "canonical"), ["dx", "dy"], "left").select("dx", "dy", "successors", F.coalesce("canonical", F.lit(0)).alias("canonical"))


QUERIES = {
    "pg08_extended_cost": lambda s, d: E.extended_costs(D.cells(s, d), D.problems(s, d)).where("cost is not null"),
    "pg08_backward_cost": lambda s, d: E.extended_costs(D.cells(s, d), D.problems(s, d), backward=True).where("cost is not null"),
    "pg08_fewest_turns": _turns,
    "pg08_successions": _sizes,
}
_OFFER = "k.c + a.c::BIGINT * 1048576 + CASE WHEN k.m <> 0 AND k.m <> a.t - a.f THEN 1 ELSE 0 END"
_CANONICAL = "(a.dx <> 0 AND a.dy <> 0 AND b.dx IN (0, a.dx) AND b.dy IN (0, a.dy)) OR (a.dx * a.dy = 0 AND a.dx = b.dx AND a.dy = b.dy)"
_SIDE = "(a.dy = 0 AND b.dy <> 0 AND b.dx IN (0, a.dx) AND (a.x, a.y + b.dy) NOT IN (SELECT (x, y) FROM cells)) OR (a.dx = 0 AND b.dx <> 0 AND b.dy IN (0, a.dy) AND (a.x + b.dx, a.y) NOT IN (SELECT (x, y) FROM cells))"
ORACLES = {
    "pg08_extended_cost": _PATHS["pg01_scenario_cost"],
    "pg08_backward_cost": _PATHS["pg01_scenario_cost"],
    "pg08_fewest_turns": f"{_R}, {_N}, {_FIRST}, k(n, m, c) USING KEY (n, m) AS (SELECT s, 0::BIGINT, 0::BIGINT FROM src UNION SELECT a.t, a.t - a.f, min({_OFFER}) FROM k JOIN arcs a ON a.f = k.n LEFT JOIN recurring.k r ON r.n = a.t AND r.m = a.t - a.f WHERE r.c IS NULL OR {_OFFER} < r.c GROUP BY a.t, a.t - a.f) SELECT n % 2147483648 AS x, n // 2147483648 AS y, min(c) // 1048576 AS cost, min(c) % 1048576 AS turns FROM k GROUP BY n",
    "pg08_successions": f"{BASE}, {ARCS_SQL}, v AS (SELECT *, x2 - x AS dx, y2 - y AS dy FROM arcs) SELECT a.dx, a.dy, count(*) AS successors, count(*) FILTER (WHERE {_CANONICAL} OR {_SIDE}) AS canonical FROM v a JOIN v b ON b.x = a.x2 AND b.y = a.y2 GROUP BY a.dx, a.dy",
}
