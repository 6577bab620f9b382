"""Readers and writers of map, problem, mesh and result files. Whole files are rows, so a folder of files is read by as
many tasks as it needs; only the mesh's token stream is parsed by a Python kernel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SEPARATED = "\\s+"
#: Columns of the result layouts.
RESULT_TSV = "id int, alg string, expd bigint, gend bigint, touched bigint, time double, cost double, sfile string"
ANYANGLE_ROWS = "exp int, alg string, wallt_micro bigint, runt_micro bigint, expanded bigint, generated bigint, heapops bigint, start string, target string, gridcost double, realcost double, map string"
NAVMESH_ROWS = "`index` int, micro double, successor_calls bigint, generated bigint, pushed bigint, popped bigint, pruned_post_pop bigint, length double, gridcost double"


def texts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, value): whole text files."""
    r = spark.read.option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def parse_maps(files: DataFrame) -> DataFrame:
    """(file, width, height, x, y, tile) of octile map texts: three header pairs in any order, the word map, and then
    height * width tiles; white space between tiles does not count. A file with a wrong type, a missing or zero size or
    another number of tiles gives no rows."""
    head, body = F.split("value", "(?m)^map\\s*$", 2)[0], F.regexp_replace(F.split("value", "(?m)^map\\s*$", 2)[1], "\\s", "")
    number = lambda k: F.expr(f"try_cast(regexp_extract(head, '(?m)^{k}\\\\s+([0-9]+)', 1) as int)")
    f = files.select("file", head.alias("head"), body.alias("body")).select("file", number("width").alias("width"), number("height").alias("height"), "body", F.col("head").rlike("(?m)^type\\s+octile\\s*$").alias("ok"))
    f = f.where("ok and width > 0 and height > 0 and length(body) = width * height")
    f = f.select("file", "width", "height", F.posexplode(F.split("body", "")).alias("i", "tile")).where("tile <> ''")
    return f.select("file", "width", "height", F.expr("cast(i % width as long)").alias("x"), F.expr("cast(i div width as long)").alias("y"), "tile")


def parse_problems(lines: DataFrame) -> DataFrame:
    """(file, row_id, bucket, map, map_w, map_h, sx, sy, gx, gy, distance, precision) of (file, row_id, value) lines.

    A file's first line says its version: `version 1` or `version 1.0` has nine fields, a bare 3 has six and sizes of 1.
    Files that begin otherwise give no rows, and neither do lines with too few fields or words for numbers."""
    first = lines.where("row_id = 0").select("file", F.regexp_extract(F.trim("value"), "^(version\\s+1(\\.0+)?|3)$", 1).alias("v")).where("v <> ''")
    rows = lines.where("row_id > 0").join(first, "file").withColumn("p", F.split(F.trim("value"), SEPARATED))
    wide, n = F.col("v").startswith("version"), F.size("p")
    part = lambda i, j: F.when(wide, F.get("p", F.lit(i))).otherwise(F.get("p", F.lit(j)))
    num = lambda c, t: c.try_cast(t)
    at = {"sx": (4, 1), "sy": (5, 2), "gx": (6, 3), "gy": (7, 4)}
    out = rows.where((wide & (n >= 9)) | (~wide & (n >= 6))).select(
        "file", "row_id", F.when(wide, num(F.get("p", F.lit(0)), "int")).otherwise(0).alias("bucket"), part(1, 0).alias("map"),
        F.when(wide, num(F.get("p", F.lit(2)), "int")).otherwise(1).alias("map_w"), F.when(wide, num(F.get("p", F.lit(3)), "int")).otherwise(1).alias("map_h"),
        *(num(part(*v), "double").alias(k) for k, v in at.items()), num(part(8, 5), "double").alias("distance"),
        F.when(F.contains(part(8, 5), F.lit(".")), F.length(F.substring_index(part(8, 5), ".", -1))).otherwise(0).alias("precision"),
    )
    return out.dropna(subset=["bucket", "map_w", "map_h", *at, "distance"])


def lines(files: DataFrame) -> DataFrame:
    """(file, row_id, value): the lines of whole texts, numbered from 0; empty lines are left out."""
    out = files.select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("row_id", "value"))
    return out.where(F.length(F.trim("value")) > 0)


MESH_SCHEMA = "file string, kind string, id int, x double, y double, links array<int>, neighbours array<int>, error string"


def _mesh(value: str) -> tuple[list[tuple], list[tuple]]:
    tokens = iter(value.split())
    if next(tokens, "") != "mesh" or next(tokens, "") != "2":
        raise ValueError("not a mesh of version 2")
    n_vertices, n_polygons = int(next(tokens)), int(next(tokens))
    if n_vertices < 1 or n_polygons < 1:
        raise ValueError("a mesh needs vertices and polygons")
    take = lambda n, least, high: [v for v in (int(next(tokens)) for _ in range(n)) if least <= v < high]
    vertices, polygons = [], []
    for _ in range(n_vertices):
        x, y, n = float(next(tokens)), float(next(tokens)), int(next(tokens))
        near = take(n, -1, n_polygons)
        if n < 2 or len(near) != n:
            raise ValueError("a vertex needs two neighbours within range")
        vertices.append((x, y, near))
    for _ in range(n_polygons):
        n = int(next(tokens))
        corners, near = take(n, 0, n_vertices), take(n, -1, n_polygons)
        if n < 3 or len(corners) != n or len(near) != n:
            raise ValueError("a polygon needs three corners and neighbours within range")
        polygons.append((corners, near))
    if next(tokens, None) is not None:
        raise ValueError("data after the last polygon")
    return vertices, polygons


def parse_meshes(files: DataFrame) -> DataFrame:
    """MESH_SCHEMA rows, of kind vertex, polygon or error, one error row for a text that is no valid mesh."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, v in zip(batch["file"], batch["value"]):
                try:
                    vertices, polygons = _mesh(v)
                except (ValueError, StopIteration) as e:
                    rows.append((f, "error", None, None, None, None, None, str(e) or "too few numbers"))
                    continue
                rows += [(f, "vertex", i, x, y, near, None, None) for i, (x, y, near) in enumerate(vertices)]
                rows += [(f, "polygon", i, None, None, corners, near, None) for i, (corners, near) in enumerate(polygons)]
            out = pd.DataFrame(rows, columns=["file", "kind", "id", "x", "y", "links", "neighbours", "error"])
            yield out.astype({"id": "Int32", "x": "Float64", "y": "Float64"})

    return files.select("file", "value").mapInPandas(run, MESH_SCHEMA)


def mesh_vertices(parsed: DataFrame) -> DataFrame:
    v = parsed.where("kind = 'vertex'")
    walls = F.size(F.filter("links", lambda p: p == -1))
    return v.select("file", F.col("id").alias("vid"), "x", "y", F.col("links").alias("polys"), (walls > 0).alias("is_corner"), (walls > 1).alias("is_ambig"))


def mesh_polygons(parsed: DataFrame) -> DataFrame:
    p, v = parsed.where("kind = 'polygon'"), parsed.where("kind = 'vertex'").select("file", F.col("id").alias("vid"), "x", "y")
    box = p.select("file", F.col("id").alias("pid"), F.explode("links").alias("vid")).join(v, ["file", "vid"]).groupBy("file", "pid").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return p.select("file", F.col("id").alias("pid"), F.col("links").alias("verts"), F.col("neighbours").alias("neigh"), (F.size(F.filter("neighbours", lambda n: n >= 0)) <= 1).alias("is_one_way")).join(box, ["file", "pid"])


def packed(values: list[int]) -> bytes:
    """Whole numbers as three bytes each, least first; -1 has all bits."""
    return b"".join(struct.pack("<I", v & 0xFFFFFF)[:3] for v in values)


def unpacked(data: bytes) -> list[int]:
    out = [int.from_bytes(data[i : i + 3], "little") for i in range(0, len(data) - 2, 3)]
    return [v - (1 << 24) if v == 0xFFFFFF else v for v in out]


def parse_stats(line: DataFrame) -> DataFrame:
    """(file, name, value) of `description : value` lines (file, value)."""
    m = "^(.*?)\\s*:\\s*([-+0-9.eE]+)\\s*$"
    return line.select("file", F.regexp_extract("value", m, 1).alias("name"), F.regexp_extract("value", m, 2).try_cast("double").alias("v")).where("name <> '' and v is not null").withColumnRenamed("v", "value")


def read_results(spark: SparkSession, paths: list[str], schema: str = RESULT_TSV, sep: str = "\t", header: bool = True) -> DataFrame:
    """Result tables of one layout, with the file each row is from; directories in `sfile` are cut off."""
    out = spark.read.schema(schema).option("sep", sep).option("header", header).csv(paths).withColumn("csv", F.regexp_extract(F.input_file_name(), "[^/]*$", 0))
    return out.withColumn("sfile", F.regexp_replace("sfile", "^.*/", "")) if "sfile" in out.columns else out


def write_results(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.option("sep", sep).option("header", True).mode("append").csv(path)


def rows_text(df: DataFrame, sep: str = ";") -> DataFrame:
    """(value): rows as text with a separator; null is an empty field."""
    return df.select(F.concat_ws(sep, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def problem_text(p: DataFrame) -> DataFrame:
    """(file, value): version 1 files of problems, in the order of row_id."""
    line = F.concat_ws("\t", "bucket", "map", "map_w", "map_h", *(F.col(c).cast("long") for c in ("sx", "sy", "gx", "gy")), F.format_string("%.4f", "distance"))
    rows = p.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row_id", line.alias("l")))).alias("r"))
    return rows.select("file", F.concat(F.lit("version 1\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n"), F.lit("\n")).alias("value"))


def map_text(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(value): an octile map file of open cells (x, y)."""
    from ..operators.grid import picture

    blank = "@" * width
    every = cells.sparkSession.range(height).withColumnRenamed("id", "y").join(picture(cells, width), "y", "left").select("y", F.coalesce("row", F.lit(blank)).alias("row"))
    body = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda r: r["row"]), "\n").alias("b"))
    return body.select(F.concat(F.lit(f"type octile\nheight {height}\nwidth {width}\nmap\n"), "b", F.lit("\n")).alias("value"))


def parse_instances(line: DataFrame, names: list[str]) -> DataFrame:
    """(file, row_id, *names) of instance files: a first line with the number of rows, then rows of whole numbers; rows
    beyond that number, and those with too few numbers, are left out."""
    first = line.where("row_id = 0").select("file", F.trim("value").try_cast("int").alias("count")).where("count is not null")
    rows = line.where("row_id > 0").join(first, "file").where("row_id <= count").withColumn("p", F.split(F.trim("value"), SEPARATED))
    return rows.select("file", "row_id", *(F.get("p", F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(names))).dropna(subset=names)


def parse_trace(line: DataFrame) -> DataFrame:
    """(file, row_id, event, numbers) of search traces: lines that say popped, generating or intermediate, with the
    numbers that they hold."""
    event = F.regexp_extract(F.lower("value"), "(popped|generating|intermediate)", 1)
    numbers = F.transform(F.regexp_extract_all("value", F.lit("([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))
    return line.select("file", "row_id", event.alias("event"), numbers.alias("numbers")).where("event <> ''")


def parse_primitives(line: DataFrame) -> DataFrame:
    """(o, o2, dx, dy, cost, swept) of motion primitives, a line each: five whole numbers, then the swept cells as pairs."""
    p = line.select(F.transform(F.split(F.trim("value"), SEPARATED), lambda v: v.try_cast("bigint")).alias("p")).where(F.size("p") >= 5)
    pairs = F.transform(F.sequence(F.lit(0), F.expr("(size(p) - 5) div 2 - 1").cast("int")), lambda i: F.struct(F.get("p", 5 + 2 * i).alias("dx"), F.get("p", 6 + 2 * i).alias("dy")))
    swept = F.when(F.size("p") >= 7, pairs).otherwise(F.array().cast("array<struct<dx:bigint,dy:bigint>>"))
    return p.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("o", "o2", "dx", "dy", "cost"))), swept.alias("swept"))


def parse_loose_problems(line: DataFrame) -> DataFrame:
    """(file, row_id, map, sx, sy, gx, gy, distance) of (file, row_id, value) lines split at tabs or spaces; lines with under
    nine fields, or with words where numbers belong, are left out, and no header is asked for."""
    p = line.select("file", "row_id", F.split(F.trim("value"), SEPARATED).alias("p")).where(F.size("p") >= 9)
    num = lambda i: F.get("p", F.lit(i))
    out = p.select("file", "row_id", num(1).alias("map"), *(num(i).try_cast("int").alias(n) for i, n in ((4, "sx"), (5, "sy"), (6, "gx"), (7, "gy"))), num(8).try_cast("double").alias("distance"))
    return out.dropna()


def parse_float_problems(line: DataFrame) -> DataFrame:
    """(file, row_id, bucket, map, sx, sy, gx, gy, distance), coordinates with a point, of files that begin with
    `version 1.0`; a file stops counting at its first line that is no problem."""
    first = line.where("row_id = 0 and trim(value) = 'version 1.0'").select("file")
    p = line.where("row_id > 0").join(first, "file").select("file", "row_id", F.split(F.trim("value"), SEPARATED).alias("p"))
    num = lambda i: F.get("p", F.lit(i)).try_cast("double")
    out = p.select("file", "row_id", F.get("p", F.lit(0)).try_cast("int").alias("bucket"), F.get("p", F.lit(1)).alias("map"), *(num(i).alias(n) for i, n in ((4, "sx"), (5, "sy"), (6, "gx"), (7, "gy"), (8, "distance"))))
    bad = out.where("bucket is null or map is null or sx is null or sy is null or gx is null or gy is null or distance is null").groupBy("file").agg(F.min("row_id").alias("end"))
    return out.join(bad, "file", "left").where("end is null or row_id < end").drop("end")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, value): the numbers of packed files, read as binary files and unpacked in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, content in zip(batch["path"], batch["content"]):
                values = unpacked(content)
                yield pd.DataFrame({"file": [f.rsplit("/", 1)[-1]] * len(values), "i": range(len(values)), "value": values})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i long, value long")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(data)
    finally:
        out.close()


def competition_rows(scores: DataFrame) -> DataFrame:
    """(value): rows of (scenario, total_time, max_step, time_20, length, subopt, valid) as pairs of labels and values."""
    pairs = (("total-time", "total_time"), ("max-time-step", "max_step"), ("time-20-moves", "time_20"), ("total-len", "length"), ("subopt", "subopt"))
    parts = [c for label, name in pairs for c in (F.lit(label), F.format_string("%.2f", F.col(name)))]
    return scores.select(F.concat_ws("\t", "scenario", *parts, F.when(F.col("valid"), "valid").otherwise("invalid")).alias("value"))


def stat_lines(stats: DataFrame) -> DataFrame:
    """(value): `description : value` lines of (name, value)."""
    return stats.select(F.concat(F.col("name"), F.lit(" : "), F.col("value").cast("string")).alias("value"))


def path_rows(paths: DataFrame) -> DataFrame:
    """(value): `path i; (x,y) (x,y) ...` of (id, points array<struct<x,y>>)."""
    points = F.array_join(F.transform("points", lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(")"))), " ")
    return paths.select(F.concat(F.lit("path "), F.col("id").cast("string"), F.lit("; "), points).alias("value"))


def mesh_text(vertices: list[tuple[float, float, list[int]]], polygons: list[tuple[list[int], list[int]]]) -> str:
    """A mesh of version 2: vertices with the polygons around them, -1 for none, and polygons with their corners and
    neighbours."""
    lines = ["mesh", "2", f"{len(vertices)} {len(polygons)}"]
    lines += [" ".join(map(str, (x, y, len(near), *near))) for x, y, near in vertices]
    lines += [" ".join(map(str, (len(corners), *corners, *near))) for corners, near in polygons]
    return "\n".join(lines) + "\n"


def square_mesh(n: int) -> str:
    """The mesh text of n times n unit squares."""
    at = lambda i, j: j * n + i if 0 <= i < n and 0 <= j < n else -1
    vertices = [(i, j, [at(i, j), at(i - 1, j), at(i - 1, j - 1), at(i, j - 1)]) for j in range(n + 1) for i in range(n + 1)]
    corner = lambda i, j: j * (n + 1) + i
    polygons = [([corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)], [at(i - 1, j), at(i, j - 1), at(i + 1, j), at(i, j + 1)]) for j in range(n) for i in range(n)]
    return mesh_text(vertices, polygons)
