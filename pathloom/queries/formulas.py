"""Queries of single formulas, queues, walks and means, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..plans import derived as D, strategies
from ..streaming import stats as T

C = F.col
P, M = D.PROBLEMS_SQL, D.MEASUREMENTS_SQL


def _intervals(s, d) -> DataFrame:
    p = D.problems(s, d)
    return p.select("id", "sx", "sy", "gx", "gy", (C("id") % 32).alias("row"), (F.least("sx", "gx") + C("id") % 3).alias("l"), (F.least("sx", "gx") + C("id") % 3 + 2 + C("id") % 5).alias("r"))


def _edges(s, d) -> DataFrame:
    p = D.problems(s, d)
    return p.select("id", "sx", "sy", "gx", "gy", (C("sx") + 2).alias("lx"), (C("sy") + C("id") % 5 - 2).alias("ly"), (C("sx") + 3 + C("id") % 4).alias("qx"), (C("sy") + C("id") % 7 - 1).alias("qy"))


def _pairs(s, d) -> DataFrame:
    return D.problems(s, d).select("id", C("sx").alias("l"), (C("sx") + C("gx") / 32.0).alias("r"), C("sy").alias("row"), (C("sx") + C("id") % 2 * 1e-9).alias("l2"), (C("sx") + C("gy") / 32.0).alias("r2"), (C("sy") + C("id") % 3 % 2).alias("row2"))


def _units(s, d) -> DataFrame:
    open_ = D.cells(s, d)
    return D.problems(s, d).join(open_.toDF("sx", "sy"), ["sx", "sy"], "left_semi").select("id", C("sx").alias("x"), C("sy").alias("y"))


def _dbl(*names):
    return [C(n).cast("double") for n in names]


def _heuristics(s, d) -> DataFrame:
    at = [C(c) for c in ("sx", "sy", "gx", "gy")]
    return D.problems(s, d).select("id", *(strategies.HEURISTICS[k](*at).cast("double").alias(k) for k in ("zero", "infinite")))


QUERIES = {
    "fn02_padded_ids": lambda s, d: D.problems(s, d).select("id", S.padded_id(C("sy") * 32 + C("sx"), 32).alias("padded")).select("id", "padded", S.unpadded_xy(C("padded"), 32)[0].alias("x"), S.unpadded_xy(C("padded"), 32)[1].alias("y")),
    "fn03_linear_boxes": lambda s, d: D.problems(s, d).select("id", S.linear3(C("sx") - 5, C("sy") - 3, C("gx"), (-5, -3, 0), (26, 28, 31)).alias("n")).select("id", "n", *(c.alias(k) for k, c in zip("xyz", S.unlinear3(C("n"), (-5, -3, 0), (26, 28, 31))))),
    "fn09_bounds": _heuristics,
    "fn10_interval_estimate": lambda s, d: _intervals(s, d).select("id", F.round(S.through_row(*_dbl("sx", "sy", "row", "l", "r", "gx", "gy")), 6).alias("h")),
    "fn11_edge_estimate": lambda s, d: _edges(s, d).where("lx <> qx or ly <> qy").select("id", F.round(S.through_edge(*_dbl("sx", "sy", "lx", "ly", "qx", "qy", "gx", "gy")), 6).alias("h")),
    "fn18_rounded_cost": lambda s, d: D.problems(s, d).select("id", S.octile(*(C(c) for c in ("sx", "sy", "gx", "gy"))).alias("h")).select("id", S.rounded_cost(C("h")).alias("cost"), (F.abs(C("h") - S.rounded_cost(C("h")) * 10000) <= 1000).alias("within")),
    "fn21_map_benchmark": lambda s, d: D.table(s, d, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ("brc000d", "ht_store", "Aftershock", "maze512-1-0", "random512-10-0", "8room_000", "lak100c", "x"))), (C("p_partkey") % 8 + 1).cast("int")), F.lit(".map")).alias("name")).select("p_partkey", S.benchmark_label(C("name")).alias("label")),
    "fn22_interval_relations": lambda s, d: _pairs(s, d).select("id", S.intervals_equal(*(C(c) for c in ("l", "r", "row", "l2", "r2", "row2"))).alias("equal"), S.interval_covers(*(C(c) for c in ("l", "r", "row", "l2", "r2", "row2"))).alias("covers"), S.interval_contains(C("l"), C("r"), C("row"), C("r2"), C("row2") + 0.0).alias("contains")),
    "ag23_connection_means": lambda s, d: D.measurements(s, d).groupBy("alg").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("time"), 6).alias("connect_time"), F.round(F.avg(C("seq") % 17), 6).alias("explored"), F.max(C("seq") % 17).alias("most")),
    "or02_least_of_heap": lambda s, d: D.measurements(s, d).withColumn("k", F.row_number().over(Window.partitionBy("alg").orderBy("time", "seq"))).where("k <= 3").select("alg", "k", "seq", "time"),
    "or04_secondary_key": lambda s, d: D.problems(s, d).groupBy("sy").agg(F.min(F.struct((C("gx") + C("gy")).alias("f"), (-C("gx")).alias("g"), "id")).alias("m")).select("sy", "m.f", (-C("m.g")).alias("g"), "m.id"),
    "or05_buckets": lambda s, d: D.problems(s, d).select(F.floor(S.octile(*(C(c) for c in ("sx", "sy", "gx", "gy"))) / 20000).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")),
    "src09_sprinkled_terrain": lambda s, d: D.grid(s, d).select("x", "y", F.when(C("q") % 4 == 0, "@").when(F.substring(F.md5(F.concat_ws(",", C("x").cast("string"), C("y").cast("string"))), 1, 1).isin("0", "1", "2", "3"), "T").otherwise(".").alias("tile")),
    "sm04_right_hand_walks": lambda s, d: T.walks(D.cells(s, d), _units(s, d), "right_hand", 12),
    "sm04_billiard_walks": lambda s, d: T.walks(D.cells(s, d), _units(s, d), "billiard", 12),
    "sm06_sessions": lambda s, d: T.drained(T.sessions(T.event_stream(s, d), "30 minutes", "1 hour"), "append"),
    "ag07_apply_median": lambda s, d: A.applied(D.measurements(s, d).select("alg", "time"), "alg", "time", lambda v: float(v.median())).select("alg", F.round("value", 6).alias("median")),
}


def _walk_sql(turns: tuple[int, ...]) -> str:
    joins = " ".join(f"LEFT JOIN cells c{t} ON c{t}.x = w.x + [0,1,0,-1][(d+{t})%4+1] AND c{t}.y = w.y + [-1,0,1,0][(d+{t})%4+1]" for t in turns)
    way = "CASE " + " ".join(f"WHEN c{t}.x IS NOT NULL THEN (d+{t})%4" for t in turns) + " END"
    start = "u AS (SELECT id, sx AS x, sy AS y FROM problems JOIN cells ON cells.x = sx AND cells.y = sy)"
    step = f"SELECT id, k+1, x + [0,1,0,-1][nd+1], y + [-1,0,1,0][nd+1], nd FROM (SELECT w.*, {way} AS nd FROM w {joins}) WHERE nd IS NOT NULL AND k < 12"
    return f"WITH RECURSIVE {D.CELLS_SQL}, {P}, {start}, w(id, k, x, y, d) AS (SELECT id, 0::BIGINT, x, y, 0::BIGINT FROM u UNION ALL {step}) SELECT * FROM w"


_CROSS = "(CASE WHEN up + down = 0 THEN sx ELSE sx + (gx - sx) * up / (up + down) END)"
_ROW = f"WITH {P}, i AS (SELECT id, sx::DOUBLE AS sx, sy::DOUBLE AS sy, gx::DOUBLE AS gx, gy::DOUBLE AS gy, (id % 32)::DOUBLE AS \"row\", (least(sx, gx) + id % 3)::DOUBLE AS l, (least(sx, gx) + id % 3 + 2 + id % 5)::DOUBLE AS r FROM problems), k AS (SELECT *, abs(sy - \"row\") AS up, abs(gy - \"row\") AS down, CASE WHEN (sy - \"row\") * (gy - \"row\") > 0 THEN 2 * \"row\" - gy ELSE gy END AS ty FROM i), z AS (SELECT *, {_CROSS} AS cx FROM k) SELECT id, round(CASE WHEN cx < l - 1e-7 THEN sqrt((sx-l)*(sx-l)+(sy-\"row\")*(sy-\"row\")) + sqrt((gx-l)*(gx-l)+(ty-\"row\")*(ty-\"row\")) WHEN cx > r + 1e-7 THEN sqrt((sx-r)*(sx-r)+(sy-\"row\")*(sy-\"row\")) + sqrt((gx-r)*(gx-r)+(ty-\"row\")*(ty-\"row\")) ELSE sqrt((sx-gx)*(sx-gx)+(sy-ty)*(sy-ty)) END, 6) AS h FROM z"
_LEN = "sqrt(({0}-{2})*({0}-{2})+({1}-{3})*({1}-{3}))"
_EDGE = f"WITH {P}, e AS (SELECT id, sx::DOUBLE AS sx, sy::DOUBLE AS sy, gx::DOUBLE AS gx, gy::DOUBLE AS gy, (sx+2)::DOUBLE AS lx, (sy + id%5 - 2)::DOUBLE AS ly, (sx + 3 + id%4)::DOUBLE AS qx, (sy + id%7 - 1)::DOUBLE AS qy FROM problems), a AS (SELECT *, (sx-lx)*(qy-ly) - (sy-ly)*(qx-lx) AS own, (gx-lx)*(qy-ly) - (gy-ly)*(qx-lx) AS other, ((gx-lx)*(qx-lx) + (gy-ly)*(qy-ly)) / ((qx-lx)*(qx-lx) + (qy-ly)*(qy-ly)) AS t FROM e WHERE lx <> qx OR ly <> qy), b AS (SELECT *, CASE WHEN (own > 0) = (other > 0) THEN 2*(lx + t*(qx-lx)) - gx ELSE gx END AS hx, CASE WHEN (own > 0) = (other > 0) THEN 2*(ly + t*(qy-ly)) - gy ELSE gy END AS hy FROM a), c AS (SELECT *, (hx-sx)*(qy-ly) - (hy-sy)*(qx-lx) AS below, (hx-lx)*(sy-ly) - (hy-ly)*(sx-lx) AS num FROM b), f AS (SELECT *, {_LEN.format('sx','sy','lx','ly')} + {_LEN.format('lx','ly','hx','hy')} AS l, {_LEN.format('sx','sy','qx','qy')} + {_LEN.format('qx','qy','hx','hy')} AS r FROM c) SELECT id, round(CASE WHEN abs(below) < 1e-8 THEN CASE WHEN {_LEN.format('sx','sy','lx','ly')} < {_LEN.format('sx','sy','qx','qy')} THEN l ELSE r END WHEN num/below < -1e-8 THEN l WHEN num/below > 1 + 1e-8 THEN r ELSE {_LEN.format('sx','sy','hx','hy')} END, 6) AS h FROM f"
ORACLES = {
    "fn02_padded_ids": f"WITH {P} SELECT id, (sy+3)*64 + sx AS padded, sx AS x, sy AS y FROM problems",
    "fn03_linear_boxes": f"WITH {P} SELECT id, (sx*32 + sy)*32 + gx AS n, sx - 5 AS x, sy - 3 AS y, gx AS z FROM problems",
    "fn09_bounds": f"WITH {P} SELECT id, 0::DOUBLE AS zero, 1.7976931348623157e307::DOUBLE AS infinite FROM problems",
    "fn10_interval_estimate": _ROW,
    "fn11_edge_estimate": _EDGE,
    "fn18_rounded_cost": f"WITH {P}, k AS (SELECT id, least(abs(sx-gx), abs(sy-gy))*14142 + (greatest(abs(sx-gx), abs(sy-gy)) - least(abs(sx-gx), abs(sy-gy)))*10000 AS h FROM problems) SELECT id, ((h + 500) // 1000) / 10.0::DOUBLE AS cost, true AS within FROM k",
    "fn21_map_benchmark": "SELECT p_partkey, ['dao','da2','sc','maze','random','room','dao',''][p_partkey % 8 + 1] AS label FROM part",
    "fn22_interval_relations": f"WITH {P}, k AS (SELECT id, sx AS l, sx + gx/32.0::DOUBLE AS r, sy AS \"row\", sx + id%2*1e-9::DOUBLE AS l2, sx + gy/32.0::DOUBLE AS r2, sy + id%3%2 AS row2 FROM problems) SELECT id, \"row\" = row2 AND abs(r-r2) < 1e-7 AS equal, \"row\" = row2 AND (abs(r-r2) < 1e-7 OR r >= r2) AS covers, \"row\" = row2 AND r2 <= r + 1e-7 AS contains FROM k",
    "ag23_connection_means": f"WITH {M} SELECT alg, count(*) AS n, round(avg(time), 6) AS connect_time, round(avg(seq % 17), 6) AS explored, max(seq % 17) AS most FROM m GROUP BY alg",
    "or02_least_of_heap": f"WITH {M}, k AS (SELECT alg, row_number() OVER (PARTITION BY alg ORDER BY time, seq) AS k, seq, time FROM m) SELECT * FROM k WHERE k <= 3",
    "or04_secondary_key": f"WITH {P}, k AS (SELECT sy, gx+gy AS f, gx AS g, id, row_number() OVER (PARTITION BY sy ORDER BY gx+gy, gx DESC, id) AS k FROM problems) SELECT sy, f, g, id FROM k WHERE k = 1",
    "or05_buckets": f"WITH {P}, k AS (SELECT (least(abs(sx-gx), abs(sy-gy))*14142 + (greatest(abs(sx-gx), abs(sy-gy)) - least(abs(sx-gx), abs(sy-gy)))*10000) // 20000 AS bucket FROM problems) SELECT bucket, count(*) AS n FROM k GROUP BY 1",
    "src09_sprinkled_terrain": f"WITH {D.GRID_SQL} SELECT x, y, CASE WHEN q % 4 = 0 THEN '@' WHEN md5(x || ',' || y)[1] IN ('0','1','2','3') THEN 'T' ELSE '.' END AS tile FROM h",
    "sm04_right_hand_walks": _walk_sql((1, 0, 3, 2)),
    "sm04_billiard_walks": _walk_sql((0, 2)),
    "sm06_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, k) SELECT user_id, start, \"end\", n FROM s WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "ag07_apply_median": f"WITH {M} SELECT alg, round(median(time), 6) AS median FROM m GROUP BY alg",
}
