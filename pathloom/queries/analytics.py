"""Queries over measurements, logs and benchmark trees, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..plans import derived as D

M, LOG, P = D.MEASUREMENTS_SQL, D.STAT_LOG_SQL, D.PROBLEMS_SQL


def _tree(s, d) -> DataFrame:
    """(region, nation, segment, value, weight): customers as maps of a benchmark tree."""
    c, n, r = (D.table(s, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(A.r6(F.avg("c_acctbal")).alias("value"), F.count(F.lit(1)).alias("weight"))


TREE = "tree AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, round(avg(c_acctbal), 6) AS value, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"


def _stats(s, d) -> DataFrame:
    """(benchmark, stat, alg, value)."""
    m = D.measurements(s, d).withColumn("benchmark", F.col("instance") % 10)
    g = m.groupBy("benchmark", "alg").agg(A.r6(F.avg("time")).alias("time"), A.r6(F.avg("dist")).alias("dist"))
    return g.select("benchmark", "alg", F.explode(F.create_map(F.lit("time"), "time", F.lit("dist"), "dist")).alias("stat", "value"))


STATS = f"{M}, g AS (SELECT instance % 10 AS benchmark, alg, round(avg(time), 6) AS time, round(avg(dist), 6) AS dist FROM m GROUP BY 1, 2), stats AS (SELECT benchmark, alg, 'time' AS stat, time AS value FROM g UNION ALL SELECT benchmark, alg, 'dist', dist FROM g)"


def _best(s, d) -> DataFrame:
    m = D.measurements(s, d).where("dist > 0")
    return m.join(m.groupBy("instance").agg(F.min("dist").alias("best")), "instance")


BEST = f"{M}, b AS (SELECT instance, min(dist) AS best FROM m WHERE dist > 0 GROUP BY 1), mb AS (SELECT m.*, best FROM m JOIN b USING (instance) WHERE dist > 0)"


def _per_alg(s, d, alg) -> DataFrame:
    return D.measurements(s, d).where(F.col("alg") == alg).groupBy("instance").agg(A.r6(F.avg("time")).alias("time"))



def _length(s, d) -> DataFrame:
    """Paths of points, (path, seq, x, y), from events."""
    e = D.table(s, d, "events")
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("x"), (F.col("event_id") * 7 % 11).alias("y"))


LENGTH = "p AS (SELECT user_id AS path, event_id AS seq, event_id % 5 AS x, event_id * 7 % 11 AS y FROM events)"
AT = ("sx", "sy", "gx", "gy")


def _c(*names):
    return [F.col(n) for n in names]


def _runs(s, d) -> DataFrame:
    """(source, run_begin, move): run-length rows of a first-move table."""
    l = D.table(s, d, "lineitem")
    return l.select((F.col("l_orderkey") % 500).alias("source"), (F.col("l_partkey") % 1000).alias("run_begin"), (F.col("l_suppkey") % 8).alias("move")).groupBy("source", "run_begin").agg(F.min("move").alias("move"))


RUNS = "runs AS (SELECT l_orderkey % 500 AS source, l_partkey % 1000 AS run_begin, min(l_suppkey % 8) AS move FROM lineitem GROUP BY 1, 2)"
KEYS = "keys AS (SELECT DISTINCT o_orderkey % 500 AS source, o_custkey % 1000 AS target FROM orders)"
_HINGES = "r AS (SELECT alg, time AS v, row_number() OVER (PARTITION BY alg ORDER BY time) AS rn, count(*) OVER (PARTITION BY alg) AS n FROM m), hd AS (SELECT *, floor((n+3)/2)/2 AS d FROM r), hinge AS (SELECT alg, avg(v) FILTER (rn = floor(d) OR rn = ceil(d)) AS lower, avg(v) FILTER (rn = floor(n+1-d) OR rn = ceil(n+1-d)) AS upper, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM hd GROUP BY alg)"
_GAMS = "SELECT alg, count(*) AS n, min(time) AS low, round(quantile_cont(time, 0.25), 6) AS q1, round(quantile_cont(time, 0.5), 6) AS median, round(avg(time), 6) AS mean, round(quantile_cont(time, 0.75), 6) AS q3, max(time) AS high, round(stddev_samp(time), 6) AS sd"

QUERIES = {
    "fn01_cell_ids": lambda s, d: D.problems(s, d).select("id", (F.col("sy") * 32 + F.col("sx")).alias("cell")).select("id", "cell", (F.col("cell") % 32).alias("x"), F.expr("cell div 32").alias("y")),
    "fn04_manhattan": lambda s, d: D.problems(s, d).select("id", S.manhattan(*_c(*AT)).alias("h")),
    "fn05_octile": lambda s, d: D.problems(s, d).select("id", S.octile(*_c(*AT)).alias("h")),
    "fn06_octile_double": lambda s, d: D.problems(s, d).select("id", A.r6(S.octile(*_c(*AT), straight=1.0, diagonal=S.ROOT2_FLOAT)).alias("h")),
    "fn07_octile_graph": lambda s, d: D.problems(s, d).select("id", A.r6(S.octile_graph(*_c(*AT))).alias("h")),
    "fn08_euclidean": lambda s, d: D.problems(s, d).select("id", A.r6(S.euclidean(*_c(*AT))).alias("h")),
    "fn12_orientation": lambda s, d: D.problems(s, d).select("id", S.orientation(*_c(*AT), F.col("sy"), F.col("gx")).alias("turn")),
    "fn13_line_times": lambda s, d: D.problems(s, d).select("id", *(A.r6(t).alias(n) for n, t in zip(("t", "u"), S.line_times(*_c("sx", "sy", "gx", "gy", "sy", "gx", "gy", "sx"))))),
    "fn14_reflection": lambda s, d: D.problems(s, d).select("id", *(A.r6(t).alias(n) for n, t in zip(("rx", "ry"), S.reflected(F.lit(3), F.lit(5), *_c(*AT))))),
    "fn15_twice_area": lambda s, d: D.problems(s, d).select("id", S.twice_area(F.array(*(F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in (("sx", "sy"), ("gx", "gy"), ("sy", "gx"))))).alias("area")),
    "fn16_direction": lambda s, d: D.problems(s, d).select("id", S.direction(F.col("gx") - F.col("sx"), F.col("gy") - F.col("sy")).alias("dir")),
    "fn17_move_split": lambda s, d: D.problems(s, d).select("id", F.greatest(*S.spans(*_c(*AT))).alias("total"), F.least(*S.spans(*_c(*AT))).alias("diagonal"), S.direction(F.signum(F.col("gx") - F.col("sx")), F.signum(F.col("gy") - F.col("sy"))).alias("dir")),
    "fn19_round_nearest": lambda s, d: D.table(s, d, "customer").select("c_custkey", S.round_to_nearest(F.col("c_acctbal"), 50).alias("v")),
    "fn20_wraparound": lambda s, d: D.table(s, d, "orders").select("o_orderkey", S.unwrapped_seconds(F.col("o_orderkey") * 37 % 86400, F.col("o_custkey") * 91 % 86400).alias("seconds")),
    "fn21_benchmark_label": lambda s, d: D.table(s, d, "part").select("p_partkey", S.benchmark_label(F.col("p_name"), [("a", "A"), ("e", "E"), ("steel", "Steel"), ("red|blue", "Color")], "Other").alias("label")),
    "src20_basename": lambda s, d: D.table(s, d, "pages").select("page_id", S.basename(F.col("url")).alias("name")),
    "fl07_category_filter": lambda s, d: A.passes(D.stat_log(s, d), ["view", "click", "purchase"], ["click"]).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    "fl10_drop_missing": lambda s, d: D.measurements(s, d).withColumn("v", F.expr("case when seq % 7 = 0 then null when seq % 11 = 0 then double('NaN') else time end")).where(F.col("v").isNotNull() & ~F.isnan("v")).select("seq", "v"),
    "fl11_outliers": lambda s, d: A.without_outliers(D.measurements(s, d), "alg", "time").select("seq", "alg", "time"),
    "fl12_path_steps": lambda s, d: _length(s, d).withColumn("nx", F.lead("x").over(Window.partitionBy("path").orderBy("seq"))).withColumn("ny", F.lead("y").over(Window.partitionBy("path").orderBy("seq"))).where("nx is not null").groupBy("path").agg(F.count(F.lit(1)).alias("steps"), F.bool_and((F.abs(F.col("nx") - F.col("x")) <= 1) & (F.abs(F.col("ny") - F.col("y")) <= 1)).alias("valid")),
    "ag01_stat_summary": lambda s, d: A.stat_summary(D.stat_log(s, d)),
    "ag02_truncated_means": lambda s, d: D.measurements(s, d).groupBy("alg").agg(F.floor(F.avg("seq")).alias("expanded"), A.r6(F.avg("time")).alias("time")),
    "ag03_report": lambda s, d: A.report(_best(s, d)),
    "ag04_derived": lambda s, d: _best(s, d).select("seq", A.r6(F.col("dist") / F.col("best")).alias("subopt"), (F.col("dist") / F.col("best") < 1.001).alias("shortest")),
    "ag05_ams": lambda s, d: A.bucketed_average(D.measurements(s, d), "dist", "time", 5),
    "ag06_gams": lambda s, d: A.grouped_summary(D.measurements(s, d), "alg", "time", 10),
    "ag06_gams_no_outliers": lambda s, d: A.grouped_summary(D.measurements(s, d), "alg", "time", 10, True),
    "ag08_chunk_mean": lambda s, d: A.chunk_means(D.measurements(s, d), "seq", "time", 16, ("alg",)),
    "ag09_run_average": lambda s, d: D.measurements(s, d).groupBy("alg", "instance").agg(A.r6(F.avg("time")).alias("time"), F.count(F.lit(1)).alias("runs")),
    "ag10_run_totals": lambda s, d: D.measurements(s, d).groupBy("alg", "run").agg(F.sum("time").alias("t")).groupBy("alg").agg(A.r6(F.avg("t")).alias("mean"), A.r6(F.sum("t")).alias("total")),
    "ag11_run_buckets": lambda s, d: A.bucketed_average(D.measurements(s, d), "dist", "time", 20, ("run",)).groupBy("mid").pivot("run", [0, 1, 2]).agg(F.first("mean")).select("mid", *(F.col(str(k)).alias(f"run_{k}") for k in range(3))),
    "ag12_rollup_weighted": lambda s, d: A.weighted_rollup(_tree(s, d), ["region", "nation", "segment"], "value", "weight"),
    "ag12_nested_means": lambda s, d: A.nested_means(_tree(s, d), ["region", "nation", "segment"], "value"),
    "ag13_empirical_rule": lambda s, d: A.empirical_rule(D.measurements(s, d), "time"),
    "ag14_empirical_dist": lambda s, d: A.empirical_distribution(D.measurements(s, d), "dist", 5),
    "ag15_session_ratio": lambda s, d: A.session_ratios(D.stat_log(s, d).withColumn("category", F.expr("case when seq % 50 = 0 then 'mark' when seq % 2 = 0 then 'top' else 'below' end")), "mark", "top", "below"),
    "ag16_experiment_scores": lambda s, d: D.measurements(s, d).withColumn("len", F.sum(F.lit(1)).over(Window.partitionBy("instance").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).groupBy("instance").agg(A.r6(F.sum("time")).alias("total_time"), F.max("time").alias("max_step"), A.r6(F.sum(F.when(F.col("len") <= 20, F.col("time")))).alias("time_20"), A.r6(F.sum("dist")).alias("length")),
    "ag17_length_classes": lambda s, d: A.length_classes(D.measurements(s, d).withColumn("length", F.col("dist") * 15), "length", "time"),
    "ag24_overlay_range": lambda s, d: D.grid(s, d).groupBy("y").agg(F.min(F.when(F.col("q") % 4 != 0, F.col("q"))).alias("low"), F.max(F.when(F.col("q") % 4 != 0, F.col("q"))).alias("high")),
    "ag25_column_sum": lambda s, d: D.measurements(s, d).agg(A.r6(F.sum("time")).alias("total")),
    "wn01_last_stat": lambda s, d: A.last_values(D.stat_log(s, d)),
    "wn02_next_prev_stat": lambda s, d: A.neighbours_in_log(D.stat_log(s, d), 500),
    "wn03_running_sum": lambda s, d: A.running_sums(D.stat_log(s, d)),
    "wn04_path_length": lambda s, d: _length(s, d).select("path", "x", "y", F.lead("x").over(Window.partitionBy("path").orderBy("seq")).alias("nx"), F.lead("y").over(Window.partitionBy("path").orderBy("seq")).alias("ny")).where("nx is not null").groupBy("path").agg(A.r6(F.sum(F.when((F.col("x") != F.col("nx")) & (F.col("y") != F.col("ny")), S.ROOT2_SCORE).otherwise(1.0))).alias("length")),
    "wn05_polyline_length": lambda s, d: _length(s, d).select("path", "x", "y", F.lag("x").over(Window.partitionBy("path").orderBy("seq")).alias("nx"), F.lag("y").over(Window.partitionBy("path").orderBy("seq")).alias("ny")).where("nx is not null").groupBy("path").agg(A.r6(F.sum(S.euclidean(*_c("x", "y", "nx", "ny")))).alias("length")),
    "or01_sorted_scenarios": lambda s, d: D.problems(s, d).withColumn("h", S.octile(*_c(*AT))).orderBy("h", "id").select("id", "h"),
    "or03_frontier_order": lambda s, d: D.problems(s, d).select("sx", "id", (F.col("gx") + F.col("gy")).alias("f"), F.col("gx").alias("g")).withColumn("k", F.row_number().over(Window.partitionBy("sx").orderBy("f", F.desc("g"), "id"))).where("k <= 3"),
    "or10_best_algorithm": lambda s, d: D.measurements(s, d).groupBy("instance").agg(F.min_by("alg", F.struct("time", "seq")).alias("alg"), F.min("time").alias("time")),
    "st01_union_runs": lambda s, d: D.measurements(s, d).where("run = 0").unionByName(D.measurements(s, d).where("run = 1")).unionByName(D.measurements(s, d).where("run = 2")).select("alg", "instance", "run", "time"),
    "st02_union_distinct": lambda s, d: D.problems(s, d).select(F.col("sx").alias("x"), F.col("sy").alias("y")).union(D.problems(s, d).select("gx", "gy")).dropDuplicates(),
    "jn10_asof_first_move": lambda s, d: A.asof(D.table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("source"), (F.col("o_custkey") % 1000).alias("target")).distinct(), _runs(s, d)).fillna(-1, ["move"]),
    "jn11_discrepancy": lambda s, d: A.discrepancies(_per_alg(s, d, "view"), _per_alg(s, d, "click"), "instance", "time", 1.0),
    "jn12_speedup": lambda s, d: A.speedup(_per_alg(s, d, "view"), _per_alg(s, d, "click"), ["instance"], "time"),
    "jn13_ratio_to_baseline": lambda s, d: A.ratio_to_baseline(_stats(s, d), "view"),
    "jn14_stat_combination": lambda s, d: A.combined(_stats(s, d), "time", "/", "dist", "time_per_dist"),
    "jn17_group_mapping": lambda s, d: D.problems(s, d).groupBy(F.col("sx").alias("member")).agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")),
    "snk11_stat_table": lambda s, d: _stats(s, d).where("stat = 'time'").groupBy("benchmark").pivot("alg", ["click", "error", "purchase", "signup", "view"]).agg(F.first("value")),
}
_PTH = f"WITH {LENGTH}, s AS (SELECT path, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY path ORDER BY seq)) SELECT path, "
_DIR = "CASE WHEN dx = 0 AND dy < 0 THEN 1 WHEN dx = 0 AND dy > 0 THEN 2 WHEN dx > 0 AND dy = 0 THEN 4 WHEN dx < 0 AND dy = 0 THEN 8 WHEN dx > 0 AND dy < 0 THEN 16 WHEN dx < 0 AND dy < 0 THEN 32 WHEN dx > 0 AND dy > 0 THEN 64 WHEN dx < 0 AND dy > 0 THEN 128 ELSE 0 END"
_PA = f"{P}, pa AS (SELECT *, abs(sx-gx) AS ax, abs(sy-gy) AS ay, gx-sx AS dx, gy-sy AS dy FROM problems)"
_PERALG = f"{M}, a AS (SELECT instance, round(avg(time), 6) AS t FROM m WHERE alg = 'view' GROUP BY 1), b AS (SELECT instance, round(avg(time), 6) AS t FROM m WHERE alg = 'click' GROUP BY 1)"
_NEAR = "CAST(trunc((v + sign(v) * {s}/2.0) / {s}) AS BIGINT) * {s}"
ORACLES = {
    "fn01_cell_ids": f"WITH {P} SELECT id, sy*32+sx AS cell, sx AS x, sy AS y FROM problems",
    "fn04_manhattan": f"WITH {_PA} SELECT id, (ax+ay)*10000 AS h FROM pa",
    "fn05_octile": f"WITH {_PA} SELECT id, least(ax,ay)*14142 + (greatest(ax,ay)-least(ax,ay))*10000 AS h FROM pa",
    "fn06_octile_double": f"WITH {_PA} SELECT id, round(least(ax,ay)*1.414213562::DOUBLE + (greatest(ax,ay)-least(ax,ay))*1.0::DOUBLE, 6) AS h FROM pa",
    "fn07_octile_graph": f"WITH {_PA} SELECT id, round(greatest(ax,ay) + least(ax,ay)*0.414121356::DOUBLE, 6) AS h FROM pa",
    "fn08_euclidean": f"WITH {_PA} SELECT id, round(sqrt(ax*ax+ay*ay), 6) AS h FROM pa",
    "fn12_orientation": f"WITH {P} SELECT id, sign((gx-sx)*(gx-gy) - (gy-sy)*(sy-gx))::INT AS turn FROM problems",
    "fn13_line_times": f"WITH {P}, q AS (SELECT *, ((gx-sx)*(sx-gx) - (gy-sy)*(gy-sy))::DOUBLE AS below FROM problems) SELECT id, round(((sy-sx)*(sx-gx) - (gx-sy)*(gy-sy)) / nullif(below, 0), 6) AS t, round(((sy-sx)*(gy-sy) - (gx-sy)*(gx-sx)) / nullif(below, 0), 6) AS u FROM q",
    "fn14_reflection": f"WITH {P}, q AS (SELECT *, gx-sx AS wx, gy-sy AS wy FROM problems), k AS (SELECT *, ((3-sx)*wx + (5-sy)*wy)::DOUBLE / nullif(wx*wx+wy*wy, 0) AS t FROM q) SELECT id, round(2*(sx+t*wx)-3, 6) AS rx, round(2*(sy+t*wy)-5, 6) AS ry FROM k",
    "fn15_twice_area": f"WITH {P} SELECT id, ((sx*gy - sy*gx) + (gx*gx - gy*sy) + (sy*sy - gx*sx))::DOUBLE AS area FROM problems",
    "fn16_direction": f"WITH {_PA} SELECT id, {_DIR} AS dir FROM pa",
    "fn17_move_split": f"WITH {_PA} SELECT id, greatest(ax,ay) AS total, least(ax,ay) AS diagonal, {_DIR} AS dir FROM pa",
    "fn19_round_nearest": f"SELECT c_custkey, {_NEAR.format(s=50)} AS v FROM (SELECT c_custkey, c_acctbal AS v FROM customer)",
    "fn20_wraparound": "WITH t AS (SELECT o_orderkey, o_orderkey*37%86400 AS a, o_custkey*91%86400 AS b FROM orders) SELECT o_orderkey, CASE WHEN b < a THEN b-a+86400 ELSE b-a END AS seconds FROM t",
    "fn21_benchmark_label": "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'Color' WHEN p_name LIKE '%steel%' THEN 'Steel' WHEN p_name LIKE '%e%' THEN 'E' WHEN p_name LIKE '%a%' THEN 'A' ELSE 'Other' END AS label FROM part",
    "src20_basename": "SELECT page_id, regexp_replace(url, '^.*/', '') AS name FROM pages",
    "fl07_category_filter": f"WITH {LOG} SELECT category, count(*) AS n FROM log WHERE category IN ('view','purchase') GROUP BY 1",
    "fl10_drop_missing": f"WITH {M} SELECT seq, time AS v FROM m WHERE seq % 7 <> 0 AND seq % 11 <> 0 AND time IS NOT NULL",
    "fl11_outliers": f"WITH {M}, {_HINGES} SELECT seq, alg, time FROM m JOIN hinge USING (alg) WHERE time BETWEEN lower - 1.5*iqr AND upper + 1.5*iqr",
    "fl12_path_steps": _PTH + "count(*) AS steps, bool_and(abs(nx-x) <= 1 AND abs(ny-y) <= 1) AS valid FROM s WHERE nx IS NOT NULL GROUP BY path",
    "ag01_stat_summary": f"WITH {LOG} SELECT category, owner, round(sum(value), 6) AS total, max(value) AS top, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM log GROUP BY 1, 2",
    "ag02_truncated_means": f"WITH {M} SELECT alg, floor(avg(seq))::BIGINT AS expanded, round(avg(time), 6) AS time FROM m GROUP BY 1",
    "ag03_report": f"WITH {BEST}, z AS (SELECT *, dist/best AS subopt FROM mb) SELECT alg, count(*) AS n, count(dist) AS n_valid, count(*) FILTER (subopt >= 1.001) AS n_subopt, round(avg(dist), 6) AS avg_length, round(avg(subopt), 6) AS avg_subopt, round(max(subopt), 6) AS max_subopt, round(sum(dist)/sum(dist/subopt), 6) AS overall_subopt, round(avg(time)*1000, 6) AS avg_ms FROM z GROUP BY alg",
    "ag04_derived": f"WITH {BEST} SELECT seq, round(dist/best, 6) AS subopt, dist/best < 1.001 AS shortest FROM mb",
    "ag05_ams": f"WITH {M} SELECT 1 + k*5 + 2.5::DOUBLE AS mid, round(avg(time), 6) AS mean, count(*) AS n, round(stddev_samp(time), 6) AS sd FROM (SELECT *, floor((dist-1)/5) AS k FROM m WHERE dist >= 1) GROUP BY k",
    "ag06_gams": f"WITH {M} {_GAMS} FROM m GROUP BY alg HAVING count(*) >= 10",
    "ag06_gams_no_outliers": f"WITH {M}, {_HINGES}, k AS (SELECT m.* FROM m JOIN hinge USING (alg) WHERE time BETWEEN lower - 1.5*iqr AND upper + 1.5*iqr) {_GAMS} FROM k GROUP BY alg HAVING count(*) >= 10",
    "ag08_chunk_mean": f"WITH {M}, k AS (SELECT *, (row_number() OVER (PARTITION BY alg ORDER BY seq) - 1) // 16 AS chunk FROM m) SELECT alg, chunk, CASE WHEN count(*) = 16 THEN round(avg(time), 6) END AS mean FROM k GROUP BY 1, 2",
    "ag09_run_average": f"WITH {M} SELECT alg, instance, round(avg(time), 6) AS time, count(*) AS runs FROM m GROUP BY 1, 2",
    "ag10_run_totals": f"WITH {M}, k AS (SELECT alg, run, sum(time) AS t FROM m GROUP BY 1, 2) SELECT alg, round(avg(t), 6) AS mean, round(sum(t), 6) AS total FROM k GROUP BY 1",
    "ag11_run_buckets": f"WITH {M}, k AS (SELECT run, 1 + floor((dist-1)/20)*20 + 10 AS mid, round(avg(time), 6) AS v FROM m WHERE dist >= 1 GROUP BY 1, 2) SELECT mid::DOUBLE AS mid, max(v) FILTER (run = 0) AS run_0, max(v) FILTER (run = 1) AS run_1, max(v) FILTER (run = 2) AS run_2 FROM k GROUP BY mid",
    "ag12_rollup_weighted": f"WITH {TREE} SELECT region, nation, segment, round(sum(value*weight)/sum(weight), 6) AS value, sum(weight)::BIGINT AS weight FROM tree GROUP BY ROLLUP (region, nation, segment)",
    "ag12_nested_means": f"WITH {TREE}, n AS (SELECT region, nation, avg(value) AS value FROM tree GROUP BY 1, 2), r AS (SELECT region, avg(value) AS value FROM n GROUP BY 1) SELECT region, nation, segment, round(value, 6) AS value FROM tree UNION ALL SELECT region, nation, NULL, round(value, 6) FROM n UNION ALL SELECT region, NULL, NULL, round(value, 6) FROM r UNION ALL SELECT NULL, NULL, NULL, round(avg(value), 6) FROM r",
    "ag13_empirical_rule": f"WITH {M}, s AS (SELECT avg(time) AS a, stddev_samp(time) AS sd FROM m) SELECT round(100*avg((abs(time-a) <= sd)::INT), 6) AS within_1, round(100*avg((abs(time-a) <= 2*sd)::INT), 6) AS within_2, round(100*avg((abs(time-a) <= 3*sd)::INT), 6) AS within_3 FROM m, s",
    "ag14_empirical_dist": f"WITH {M}, k AS (SELECT {_NEAR.format(s=5).replace('v', 'dist')} AS value, count(*) AS freq FROM m GROUP BY 1) SELECT value, freq, round(freq / sum(freq) OVER (), 6) AS probability FROM k",
    "ag15_session_ratio": f"WITH {LOG}, c AS (SELECT seq, value, CASE WHEN seq % 50 = 0 THEN 'mark' WHEN seq % 2 = 0 THEN 'top' ELSE 'below' END AS category FROM log), s AS (SELECT *, sum((category = 'mark')::INT) OVER (ORDER BY seq) AS session FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY session, category ORDER BY seq) AS k FROM s WHERE category <> 'mark') SELECT a.session::BIGINT AS session, count(*) AS n, round(avg(a.value/b.value), 6) AS ratio FROM k a JOIN k b ON a.session = b.session AND a.k = b.k AND a.category = 'top' AND b.category = 'below' WHERE b.value <> 0 GROUP BY a.session",
    "ag16_experiment_scores": f"WITH {M}, k AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY seq) AS len FROM m) SELECT instance, round(sum(time), 6) AS total_time, max(time) AS max_step, round(sum(time) FILTER (len <= 20), 6) AS time_20, round(sum(dist), 6) AS length FROM k GROUP BY 1",
    "ag17_length_classes": f"WITH {M}, k AS (SELECT *, dist*15 AS l FROM m) SELECT CASE WHEN l <= 150 THEN 0 WHEN l <= 300 THEN 1 WHEN l <= 500 THEN 2 WHEN l <= 750 THEN 3 WHEN l <= 1200 THEN 4 ELSE 5 END AS class, count(*) AS calls, round(sum(time), 6) AS total_time FROM k GROUP BY 1",
    "ag24_overlay_range": f"WITH {D.GRID_SQL} SELECT y, min(q) FILTER (q % 4 <> 0) AS low, max(q) FILTER (q % 4 <> 0) AS high FROM h GROUP BY y",
    "ag25_column_sum": f"WITH {M} SELECT round(sum(time), 6) AS total FROM m",
    "wn01_last_stat": f"WITH {LOG} SELECT category, owner, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY 1, 2",
    "wn02_next_prev_stat": f"WITH {LOG} SELECT category, min(seq) FILTER (seq >= 500) AS next_seq, max(seq) FILTER (seq <= 500 AND seq > 0) AS prev_seq FROM log GROUP BY 1",
    "wn03_running_sum": f"WITH {LOG} SELECT seq, category, owner, round(sum(value) OVER (PARTITION BY category, owner ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS running FROM log",
    "wn04_path_length": _PTH + "round(sum(CASE WHEN x <> nx AND y <> ny THEN 1.4142::DOUBLE ELSE 1.0 END), 6) AS length FROM s WHERE nx IS NOT NULL GROUP BY path",
    "wn05_polyline_length": _PTH + "round(sum(sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny))), 6) AS length FROM s WHERE nx IS NOT NULL GROUP BY path",
    "or01_sorted_scenarios": f"WITH {_PA} SELECT id, least(ax,ay)*14142 + (greatest(ax,ay)-least(ax,ay))*10000 AS h FROM pa ORDER BY h, id",
    "or03_frontier_order": f"WITH {P}, k AS (SELECT sx, id, gx+gy AS f, gx AS g, row_number() OVER (PARTITION BY sx ORDER BY gx+gy, gx DESC, id) AS k FROM problems) SELECT * FROM k WHERE k <= 3",
    "or10_best_algorithm": f"WITH {M}, k AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY time, seq) AS k FROM m) SELECT instance, alg, time FROM k WHERE k = 1",
    "st01_union_runs": f"WITH {M} SELECT alg, instance, run, time FROM m",
    "st02_union_distinct": f"WITH {P} SELECT sx AS x, sy AS y FROM problems UNION SELECT gx, gy FROM problems",
    "jn10_asof_first_move": f"WITH {RUNS}, {KEYS} SELECT k.source, k.target, COALESCE(arg_max(move, run_begin), -1) AS move FROM keys k LEFT JOIN runs r ON r.source = k.source AND r.run_begin <= k.target GROUP BY 1, 2",
    "jn11_discrepancy": f"WITH {_PERALG} SELECT instance, a.t AS a, b.t AS b FROM a JOIN b USING (instance) WHERE abs(a.t - b.t) > 1.0",
    "jn12_speedup": f"WITH {_PERALG} SELECT instance, round(a.t / nullif(b.t, 0), 6) AS speedup FROM a JOIN b USING (instance)",
    "jn13_ratio_to_baseline": f"WITH {STATS} SELECT s.benchmark, s.stat, s.alg, CASE WHEN s.value > 0 THEN round(b.value/s.value, 6) ELSE 0.0::DOUBLE END AS ratio FROM stats s JOIN stats b ON b.benchmark = s.benchmark AND b.stat = s.stat AND b.alg = 'view'",
    "jn14_stat_combination": f"WITH {STATS} SELECT benchmark, alg, 'time_per_dist' AS stat, round(time/nullif(dist, 0), 6) AS value FROM g",
    "jn17_group_mapping": f"WITH {P} SELECT sx AS member, min(id) AS group_id, count(*) AS n FROM problems GROUP BY 1",
    "snk11_stat_table": f"WITH {STATS} SELECT benchmark, " + ", ".join(f"max(time) FILTER (alg = '{a}') AS \"{a}\"" for a in ("click", "error", "purchase", "signup", "view")) + " FROM g GROUP BY 1",
}
