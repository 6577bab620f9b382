"""Queries that write files and read them again, or form the rows of a layout, and their SQL forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import grid as G
from ..plans import derived as D
from ..plans.scratch import root
from ..sources import maps as R
from . import analytics as AQ, grid as GQ, paths as Q
from .grid import BASE
from .paths import _N

C, M = F.col, D.MEASUREMENTS_SQL


def _place(s: SparkSession) -> str:
    return f"{root(s)}/files-{uuid.uuid4().hex}"


def _read_again(files: DataFrame) -> DataFrame:
    """(file, value) written as one text file for each and read as whole texts."""
    path = _place(files.sparkSession)
    files.write.partitionBy("file").text(path)
    return R.texts(files.sparkSession, path).select(F.regexp_extract("file", "file=([^/]*)/", 1).alias("file"), "value")


def _files(lines: DataFrame, header) -> DataFrame:
    """(file, value) from lines (file, id, line), in the order of id, after a header that depends on the file."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda v: v["line"]), "\n")
    return lines.groupBy("file").agg(body.alias("body")).select("file", F.concat(header, F.lit("\n"), "body").alias("value"))


def _asked(s, d) -> DataFrame:
    """Problems with a file of their own each eighth, and their fields as text."""
    p = D.problems(s, d).withColumn("file", F.concat(F.lit("f"), C("id") % 8))
    wide = F.concat_ws("\t", *(F.lit(v) for v in ("7", "m.map", "32", "32")), *(C(c).cast("string") for c in ("sx", "sy", "gx", "gy")), F.lit("5.25"))
    short = F.concat_ws(" ", F.lit("m.map"), *(C(c).cast("string") for c in ("sx", "sy", "gx", "gy")), F.lit("5.5"))
    return p.withColumns({"wide": wide, "short": short})


def _versions(s, d) -> DataFrame:
    k = C("id") % 8
    lines = _asked(s, d).select("file", "id", F.when(k % 4 == 2, C("short")).otherwise(C("wide")).alias("line"))
    n = F.substring("file", 2, 1).cast("int") % 4
    header = F.when(n == 0, "version 1").when(n == 1, "version 1.0").when(n == 2, "3").otherwise("2")
    got = R.parse_problems(R.lines(_read_again(_files(lines, header))))
    return got.groupBy("file", "bucket", "map_w", "precision").agg(F.count(F.lit(1)).alias("n"), F.sum(C("sx") + C("gy")).cast("long").alias("total"))


def _bare(s, d) -> DataFrame:
    got = R.parse_problems(R.lines(_read_again(_files(_asked(s, d).select("file", "id", C("short").alias("line")), F.lit("3")))))
    return got.select("file", "bucket", "map", C("sx").cast("long").alias("sx"), C("gy").cast("long").alias("gy"), "distance", "precision")


def _loose(s, d) -> DataFrame:
    k = C("id") % 4
    line = F.when(k == 0, C("wide")).when(k == 1, F.translate("wide", "\t", " ")).when(k == 2, C("short")).otherwise(F.regexp_replace("wide", "\t[0-9.]+$", "\tx"))
    got = R.parse_loose_problems(R.lines(_read_again(_files(_asked(s, d).select("file", "id", line.alias("line")), F.lit("version 1")))))
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(C("sx") * 100 + C("gy")).cast("long").alias("total"))


def _floats(s, d) -> DataFrame:
    line = F.concat_ws(" ", F.lit("1"), F.lit("a.mesh"), F.lit("32"), F.lit("32"), *(F.concat(C(c).cast("string"), F.lit(".5")) for c in ("sx", "sy", "gx", "gy")), F.lit("2.5"))
    n = F.substring("file", 2, 1).cast("int")
    got = R.parse_float_problems(R.lines(_read_again(_files(_asked(s, d).select("file", "id", line.alias("line")), F.when(n % 2 == 0, "version 1.0").otherwise("version 2.0")))))
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(C("sx") + C("gy")), 6).alias("total"))


def _text(s, name: str, value: str) -> DataFrame:
    return _read_again(s.range(1).select(F.lit(name).alias("file"), F.lit(value).alias("value")))


def _mesh(s) -> DataFrame:
    return R.parse_meshes(_text(s, "squares", R.square_mesh(6)))


def _packed(s, d) -> DataFrame:
    path = _place(s)
    R.write_bytes(s, f"{path}/a.pack", R.packed([-1 if i % 10 == 0 else i * 7919 % 70000 for i in range(500)]))
    return R.read_packed(s, f"{path}/a.pack")


def _traces(s, d) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("popped", "generating", "intermediate", "noise"))), (C("id") % 4 + 1).cast("int"))
    line = F.concat(words, F.lit(" root=("), C("sx").cast("string"), F.lit(", "), C("sy").cast("string"), F.lit(") f="), C("gx").cast("string"), F.lit(".5"))
    got = R.parse_trace(R.lines(_read_again(_files(_asked(s, d).select("file", "id", line.alias("line")), F.lit("trace")))))
    return got.groupBy("file", "event").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("numbers", F.lit(0.0), lambda a, v: a + v)), 6).alias("total"))


def _results(s, d) -> DataFrame:
    m = D.measurements(s, d)
    return m.select(C("seq").cast("int").alias("id"), "alg", (C("seq") % 100).alias("expd"), (C("seq") % 200).alias("gend"), (C("seq") % 50).alias("touched"), C("dist").cast("double").alias("time"), (C("dist") * 2).cast("double").alias("cost"), F.concat(F.lit("maps/set-"), C("run").cast("string"), F.lit("/a.scen")).alias("sfile"), "run")


def _csv_union(s, d) -> DataFrame:
    paths = []
    for run in range(3):
        paths.append(f"{_place(s)}/run{run}")
        R.write_results(_results(s, d).where(C("run") == run).drop("run"), paths[-1])
    out = s.read.schema(R.RESULT_TSV).option("sep", "\t").option("header", True).csv(paths).withColumn("csv", F.regexp_extract(F.input_file_name(), "/(run[0-9])/", 1))
    return out.groupBy("csv", "alg").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def _typed(s, d) -> DataFrame:
    path = _place(s)
    R.write_results(_results(s, d).drop("run"), path)
    return R.read_results(s, [path]).select("id", "alg", "expd", "gend", "touched", "time", "cost", "sfile")


def _discovered(s, d) -> DataFrame:
    path, text = _place(s), R.map_text(D.cells(s, d), 32, 32).first()["value"].encode()
    for name in ("a/x.map", "a/b/y.map", "c/z.txt"):
        R.write_bytes(s, f"{path}/{name}", text)
    got = R.parse_maps(R.texts(s, path, "*.map"))
    return got.where("tile = '.'").groupBy(F.regexp_extract("file", "[^/]*$", 0).alias("name")).agg(F.count(F.lit(1)).alias("open"))


def _instances(s, d) -> DataFrame:
    p = _asked(s, d)
    n = p.groupBy("file").agg((F.count(F.lit(1)) - 1).cast("string").alias("n"))
    lines = p.select("file", "id", F.concat_ws(" ", *(C(c).cast("string") for c in ("sx", "sy", "gx", "gy"))).alias("line"))
    body = _files(lines, F.lit("")).join(n, "file").select("file", F.concat("n", "value").alias("value"))
    return R.parse_instances(R.lines(_read_again(body)), ["sx", "sy", "gx", "gy"]).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def _primitives(s, d) -> DataFrame:
    text = "\n".join(f"{o} {(o + 1) % 8} {o % 3} {o % 2} {10000 + o} " + " ".join(f"{k} {o}" for k in range(o)) for o in range(8))
    got = R.parse_primitives(R.lines(_text(s, "p", text)))
    return got.select("o", "o2", "dx", "dy", "cost", F.size("swept").cast("long").alias("n"))


def _stored(df: DataFrame, *by: str) -> DataFrame:
    path = _place(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def _history(s, d) -> DataFrame:
    e = D.table(s, d, "events")
    return e.select(C("user_id").alias("unit"), C("event_id").alias("seq"), C("value").alias("t"), (C("event_id") % 5).alias("x"), (C("event_id") * 7 % 11).alias("y"))


def _scores(s, d) -> DataFrame:
    m = D.measurements(s, d).withColumn("len", F.row_number().over(AQ.Window.partitionBy("instance").orderBy("seq")))
    whole = lambda c: c.cast("double")
    return m.groupBy(F.concat(F.lit("s"), C("instance").cast("string")).alias("scenario")).agg(
        whole(F.sum(F.floor("time"))).alias("total_time"), whole(F.max(F.floor("time"))).alias("max_step"), whole(F.coalesce(F.sum(F.when(C("len") <= 20, F.floor("time"))), F.lit(0))).alias("time_20"),
        whole(F.sum(F.floor("dist"))).alias("length"), whole(F.count(F.lit(1))).alias("subopt"), (F.min("dist") > 1).alias("valid"),
    )


def _graph_sizes(s, d) -> DataFrame:
    a = Q._arcs(s, d)
    return a.agg(F.lit("grid32").alias("map"), F.count_distinct("source").alias("nodes"), F.count(F.lit(1)).alias("arcs"))


QUERIES = {
    "src11_versions": _versions,
    "src12_bare_files": _bare,
    "src13_loose_files": _loose,
    "src14_float_files": _floats,
    "src15_mesh_vertices": lambda s, d: R.mesh_vertices(_mesh(s)).select(C("vid").cast("long").alias("vid"), "x", "y", F.size(F.filter("polys", lambda p: p >= 0)).cast("long").alias("n"), "is_corner", "is_ambig"),
    "src15_mesh_polygons": lambda s, d: R.mesh_polygons(_mesh(s)).select(C("pid").cast("long").alias("pid"), "is_one_way", "min_x", "max_x", "min_y", "max_y"),
    "src16_packed_numbers": _packed,
    "src17_traces": _traces,
    "src18_csv_union": _csv_union,
    "src19_typed_results": _typed,
    "src22_discovered_maps": _discovered,
    "src23_label_cache": lambda s, d: _stored(G.jump_labels(D.cells(s, d)).withColumn("map", F.lit("grid32")), "map").select("x", "y", "dir", "steps"),
    "src24_instances": _instances,
    "src25_imported_graph": lambda s, d: _stored(G.jump_labels(D.cells(s, d)).select("x", "y", "jx", "jy", "dir"), "dir").groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum(C("jx") + C("jy")).alias("total")),
    "src26_primitives": _primitives,
    "src27_history": lambda s, d: _stored(_history(s, d).withColumn("part", C("unit") % 4), "part").drop("part"),
    "snk01_result_rows": lambda s, d: R.rows_text(_results(s, d).select("id", "alg", "expd", "gend", "touched", C("time").cast("decimal(20,1)").alias("time"), C("cost").cast("decimal(20,1)").alias("cost"), "sfile"), "\t"),
    "snk02_anyangle_rows": lambda s, d: R.rows_text(D.problems(s, d).select("id", F.lit("anyangle").alias("alg"), (C("id") % 97).alias("w"), (C("id") % 89).alias("r"), (C("id") % 83).alias("e"), (C("id") % 79).alias("g"), (C("id") % 73).alias("h"), F.format_string("(%d, %d)", "sx", "sy").alias("s"), F.format_string("(%d, %d)", "gx", "gy").alias("t"), F.abs(C("sx") - C("gx")).alias("c"), F.abs(C("sy") - C("gy")).alias("l"), F.lit("grid32.map").alias("map"))),
    "snk03_path_rows": lambda s, d: R.path_rows(D.problems(s, d).select("id", F.array(F.struct(C("sx").alias("x"), C("sy").alias("y")), F.struct(C("sx").alias("x"), C("gy").alias("y")), F.struct(C("gx").alias("x"), C("gy").alias("y"))).alias("points"))),
    "snk04_competition_rows": lambda s, d: R.competition_rows(_scores(s, d)),
    "snk05_appended_by_algorithm": lambda s, d: _stored(D.measurements(s, d).select("seq", "alg", "time"), "alg"),
    "snk06_graph_sizes": lambda s, d: R.rows_text(_graph_sizes(s, d), "\t"),
    "snk07_stat_report": lambda s, d: R.stat_lines(D.measurements(s, d).groupBy("alg").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("m")).select(F.explode(F.array(F.struct(F.concat(F.lit("queries of "), "alg").alias("name"), C("n").alias("value")), F.struct(F.concat(F.lit("last of "), "alg").alias("name"), C("m").alias("value")))).alias("x")).select("x.name", "x.value")),
    "snk07_instance_rows": lambda s, d: R.rows_text(_results(s, d).select("touched", "expd", "gend", C("cost").cast("decimal(20,1)").alias("dist"), (C("cost") > 1).alias("valid"), (C("expd") == 0).alias("shortest")), "\t"),
    "snk12_exported_graph": lambda s, d: _stored(Q._arcs(s, d).withColumn("part", C("source") % 4), "part").select("source", "target", "cost"),
}
_A = f"WITH {D.PROBLEMS_SQL}, a AS (SELECT *, 'f' || (id % 8) AS file, id % 8 % 4 AS k FROM problems)"
_JL = f"WITH jl AS ({GQ.ORACLES['pg13_jump_labels']})"
_RES = f"WITH {M}, r AS (SELECT seq::INT AS id, alg, seq % 100 AS expd, seq % 200 AS gend, seq % 50 AS touched, dist::DOUBLE AS time, (dist*2)::DOUBLE AS cost, 'maps/set-' || run || '/a.scen' AS sfile, run FROM m)"
ORACLES = {
    "src11_versions": f"{_A} SELECT file, CASE WHEN k = 2 THEN 0 ELSE 7 END AS bucket, CASE WHEN k = 2 THEN 1 ELSE 32 END AS map_w, CASE WHEN k = 2 THEN 1 ELSE 2 END AS precision, count(*) AS n, sum(sx+gy)::BIGINT AS total FROM a WHERE k < 3 GROUP BY 1, 2, 3, 4",
    "src12_bare_files": f"{_A} SELECT file, 0 AS bucket, 'm.map' AS map, sx, gy, 5.5::DOUBLE AS distance, 1 AS precision FROM a",
    "src13_loose_files": f"{_A} SELECT file, count(*) AS n, sum(sx*100+gy)::BIGINT AS total FROM a WHERE id % 4 < 2 GROUP BY file",
    "src14_float_files": f"{_A} SELECT file, count(*) AS n, round(sum(sx+gy+1.0::DOUBLE), 6) AS total FROM a WHERE id % 2 = 0 GROUP BY file",
    "src15_mesh_vertices": "SELECT j*7+i AS vid, i::DOUBLE AS x, j::DOUBLE AS y, (CASE WHEN i IN (0,6) THEN 1 ELSE 2 END * CASE WHEN j IN (0,6) THEN 1 ELSE 2 END)::BIGINT AS n, i IN (0,6) OR j IN (0,6) AS is_corner, i IN (0,6) OR j IN (0,6) AS is_ambig FROM range(7) a(i) CROSS JOIN range(7) b(j)",
    "src15_mesh_polygons": "SELECT j*6+i AS pid, false AS is_one_way, i::DOUBLE AS min_x, (i+1)::DOUBLE AS max_x, j::DOUBLE AS min_y, (j+1)::DOUBLE AS max_y FROM range(6) a(i) CROSS JOIN range(6) b(j)",
    "src16_packed_numbers": "SELECT 'a.pack' AS file, i, CASE WHEN i % 10 = 0 THEN -1 ELSE i*7919 % 70000 END AS value FROM range(500) t(i)",
    "src17_traces": f"{_A} SELECT file, ['popped','generating','intermediate'][id % 4 + 1] AS event, count(*) AS n, round(sum(sx+sy+gx+0.5::DOUBLE), 6) AS total FROM a WHERE id % 4 < 3 GROUP BY 1, 2",
    "src18_csv_union": f"{_RES} SELECT 'run' || run AS csv, alg, count(*) AS n, round(sum(cost), 6) AS cost FROM r GROUP BY 1, 2",
    "src19_typed_results": f"{_RES} SELECT id, alg, expd, gend, touched, time, cost, 'a.scen' AS sfile FROM r",
    "src22_discovered_maps": f"WITH {D.CELLS_SQL} SELECT name, count(*) AS open FROM cells CROSS JOIN (VALUES ('x.map'), ('y.map')) t(name) GROUP BY name",
    "src23_label_cache": f"{_JL} SELECT x, y, dir, steps FROM jl",
    "src24_instances": f"{_A} SELECT file, count(*) - 1 AS n FROM a GROUP BY file HAVING count(*) > 1",
    "src25_imported_graph": f"{_JL}, e AS (SELECT dir, x + steps * CASE WHEN dir IN (4,16,64) THEN 1 WHEN dir IN (8,32,128) THEN -1 ELSE 0 END + y + steps * CASE WHEN dir IN (2,64,128) THEN 1 WHEN dir IN (1,16,32) THEN -1 ELSE 0 END AS t FROM jl) SELECT dir, count(*) AS n, sum(t)::BIGINT AS total FROM e GROUP BY dir",
    "src26_primitives": "SELECT o, (o+1) % 8 AS o2, o % 3 AS dx, o % 2 AS dy, 10000 + o AS cost, o AS n FROM range(8) t(o)",
    "src27_history": "SELECT user_id AS unit, event_id AS seq, value AS t, event_id % 5 AS x, event_id * 7 % 11 AS y FROM events",
    "snk01_result_rows": f"{_RES} SELECT concat_ws(chr(9), id, alg, expd, gend, touched, time::DECIMAL(20,1), cost::DECIMAL(20,1), sfile) AS value FROM r",
    "snk02_anyangle_rows": f"{_A} SELECT concat_ws(';', id, 'anyangle', id % 97, id % 89, id % 83, id % 79, id % 73, '(' || sx || ', ' || sy || ')', '(' || gx || ', ' || gy || ')', abs(sx-gx), abs(sy-gy), 'grid32.map') AS value FROM a",
    "snk03_path_rows": f"{_A} SELECT 'path ' || id || '; (' || sx || ',' || sy || ') (' || sx || ',' || gy || ') (' || gx || ',' || gy || ')' AS value FROM a",
    "snk04_competition_rows": f"WITH {M}, k AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY seq) AS len FROM m) SELECT concat_ws(chr(9), 's' || instance, 'total-time', printf('%.2f', sum(floor(time))::DOUBLE), 'max-time-step', printf('%.2f', max(floor(time))::DOUBLE), 'time-20-moves', printf('%.2f', coalesce(sum(floor(time)) FILTER (len <= 20), 0)::DOUBLE), 'total-len', printf('%.2f', sum(floor(dist))::DOUBLE), 'subopt', printf('%.2f', count(*)::DOUBLE), CASE WHEN min(dist) > 1 THEN 'valid' ELSE 'invalid' END) AS value FROM k GROUP BY instance",
    "snk05_appended_by_algorithm": f"WITH {M} SELECT seq, alg, time FROM m",
    "snk06_graph_sizes": f"{BASE}, {_N} SELECT concat_ws(chr(9), 'grid32', count(DISTINCT f), count(*)) AS value FROM arcs",
    "snk07_stat_report": f"WITH {M}, k AS (SELECT alg, count(*) AS n, max(seq) AS m FROM m GROUP BY alg) SELECT 'queries of ' || alg || ' : ' || n AS value FROM k UNION ALL SELECT 'last of ' || alg || ' : ' || m FROM k",
    "snk07_instance_rows": f"{_RES} SELECT concat_ws(chr(9), touched, expd, gend, cost::DECIMAL(20,1), (cost > 1)::VARCHAR, (expd = 0)::VARCHAR) AS value FROM r",
    "snk12_exported_graph": f"{BASE}, {_N} SELECT f AS source, t AS target, c AS cost FROM arcs",
}
