"""Stream queries, drained over the tables that are there, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators.paths import WIDTH, node
from ..plans import derived as D
from ..plans.scratch import stored
from ..streaming import contention as C, stats as T
from .grid import BASE


def _log(e):
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), (F.col("user_id") % 7).alias("owner"), "value")


def _units(s, d):
    e = D.table(s, d, "events")
    return e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("seq"), "value", (F.col("event_id") % 5).alias("x"), (F.col("event_id") * 7 % 11).alias("y"))


#: Ticks of the shared maps.
TICKS = 16


def _crowd(s, d, cells):
    """Users as units on every second open cell, a map for each policy."""
    ranks = G.ranked(cells.select(node("x", "y").alias("node")))
    users = D.table(s, d, "events").select(F.col("user_id").alias("unit")).distinct().withColumn("rank", F.col("unit") * 2)
    policies = F.explode(F.array(*map(F.lit, ("billiard", "random", "right_hand", "teleport")))).alias("policy")
    return users.join(ranks, "rank").select(policies, F.col("unit").cast("long").alias("unit"), (F.col("node") % WIDTH).alias("x"), F.expr(f"node div {WIDTH}").alias("y"))


def _contested(s, d):
    cells = stored(D.cells(s, d), "cells")  # the line items are read once, for the map and the crowd
    return C.contested(cells, _crowd(s, d, cells), TICKS)


QUERIES = {
    "sm03_blocked_moves": lambda s, d: _contested(s, d).select("policy", "unit", "tick", "x", "y", "clock", "moves", "blocked"),
    "sm04_travelled": lambda s, d: _contested(s, d).groupBy("policy", "tick").agg(F.sum("distance").alias("distance"), F.sum("blocked").alias("blocked"), F.max("clock").alias("latest")),
    "sm01_unit_replay": lambda s, d: T.simulated(_units(s, d)),
    "sm02_ticks": lambda s, d: T.drained(T.ticks(T.event_stream(s, d), "1 hour")),
    "sm03_unit_states": lambda s, d: T.drained(T.unit_states(T.event_stream(s, d)), "update").groupBy("unit").agg(F.max_by(F.struct("n", F.round("t", 4).alias("t")), "seq").alias("r")).select("unit", "r.n", "r.t"),
    "sm05_stat_stream": lambda s, d: T.drained(T.log_totals(_log(T.event_stream(s, d)), exclude=["error"])),
    "sm07_all_done": lambda s, d: _units(s, d).groupBy("unit").agg(F.max("seq").alias("last")).agg(F.bool_and(F.col("last") > 100).alias("done")),
    "ext_sliding_windows": lambda s, d: T.drained(T.windows(T.event_stream(s, d), "2 hours", "1 hour", "1 day")),
}
_TURNS = ", ".join(f"('{p}', {k}, {t})" for p, turns in C.TURNS.items() for k, t in enumerate(turns))
_ACTS = """SELECT tick, policy, unit, clock, k, x2, y2, d2, cost FROM (
  SELECT s.tick, s.policy, s.unit, s.clock, s.x, s.y, t.k, (s.d + t.turn) % 8 AS d2 FROM st s JOIN turns t ON t.policy = s.policy WHERE s.clock <= s.tick * 10000
  UNION ALL SELECT tick, policy, unit, clock, x, y, 0, (unit * 7919 + tick * 104729) % 8 FROM st WHERE policy = 'random' AND clock <= tick * 10000) JOIN legal USING (x, y, d2)
  UNION ALL SELECT tick, policy, unit, clock, 0, rk.x, rk.y, d, 10000 FROM st JOIN rk ON rank = (unit * 31 + tick * 17) % (SELECT count(*) FROM cells) WHERE policy = 'teleport' AND clock <= tick * 10000"""
_REPLAY = f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, turns(policy, k, turn) AS (VALUES {_TURNS}), compass(d2, dx, dy) AS (VALUES {", ".join(str((k, *m)) for k, m in enumerate(G.MOVES))}),
legal AS (SELECT c.x, c.y, d2::BIGINT AS d2, t.x AS x2, t.y AS y2, CASE WHEN dx <> 0 AND dy <> 0 THEN 14142 ELSE 10000 END AS cost FROM cells c CROSS JOIN compass JOIN cells t ON t.x = c.x+dx AND t.y = c.y+dy JOIN cells a ON a.x = c.x+dx AND a.y = c.y JOIN cells b ON b.x = c.x AND b.y = c.y+dy),
rk AS (SELECT x, y, row_number() OVER (ORDER BY y, x) - 1 AS rank FROM cells),
st(tick, policy, unit, x, y, d, clock, moves, blocked, distance) AS (
 SELECT 0::BIGINT, policy, unit, x, y, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id AS unit FROM events) JOIN rk ON rank = unit * 2 CROSS JOIN (VALUES ('billiard'), ('random'), ('right_hand'), ('teleport')) p(policy)
 UNION ALL
 SELECT s.tick + 1, s.policy, s.unit, coalesce(w.x2, s.x), coalesce(w.y2, s.y), coalesce(w.d2, s.d), s.clock + CASE WHEN w.unit IS NOT NULL THEN w.cost WHEN s.clock <= s.tick * 10000 THEN 10000 ELSE 0 END,
  s.moves + (w.unit IS NOT NULL)::BIGINT, s.blocked + (w.unit IS NULL AND s.clock <= s.tick * 10000)::BIGINT, s.distance + coalesce(w.cost, 0)
 FROM st s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy, x2, y2 ORDER BY clock, unit) AS first FROM (
   SELECT *, row_number() OVER (PARTITION BY policy, unit ORDER BY k) AS best FROM ({_ACTS}) a WHERE NOT EXISTS (SELECT 1 FROM st o WHERE o.policy = a.policy AND o.x = a.x2 AND o.y = a.y2)) WHERE best = 1) WHERE first = 1) w ON w.policy = s.policy AND w.unit = s.unit
 WHERE s.tick < {TICKS})"""
ORACLES = {
    "sm03_blocked_moves": f"{_REPLAY} SELECT policy, unit, tick, x, y, clock, moves, blocked FROM st",
    "sm04_travelled": f"{_REPLAY} SELECT policy, tick, sum(distance)::BIGINT AS distance, sum(blocked)::BIGINT AS blocked, max(clock) AS latest FROM st GROUP BY policy, tick",
    "sm01_unit_replay": "WITH u AS (SELECT user_id AS unit, event_id AS seq, value, event_id%5 AS x, event_id*7%11 AS y FROM events), s AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)), 0) AS step FROM u WINDOW w AS (PARTITION BY unit ORDER BY seq)) SELECT unit, seq, round(sum(value) OVER w, 6) AS t, round(sum(step) OVER w, 6) AS distance FROM s WINDOW w AS (PARTITION BY unit ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "sm02_ticks": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "sm03_unit_states": "SELECT user_id AS unit, count(*) AS n, round(sum(value), 4) AS t FROM events GROUP BY 1",
    "sm05_stat_stream": "SELECT event_type AS category, user_id % 7 AS owner, round(sum(value), 6) AS total, count(*) AS n, arg_max(value, event_id) AS last FROM events WHERE event_type <> 'error' GROUP BY 1, 2",
    "sm07_all_done": "SELECT bool_and(m > 100) AS done FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id)",
    "ext_sliding_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events CROSS JOIN range(2) t(k) GROUP BY 1, 2",
}
