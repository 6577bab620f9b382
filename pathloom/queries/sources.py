"""Queries that run readers and writers against each other: what is written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import grid as G
from ..plans import derived as D
from ..sources import maps as R


def _files(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("file"), "value")


def _map(s, d) -> DataFrame:
    return R.parse_maps(_files(R.map_text(D.cells(s, d), 32, 32), "grid32.map"))


def _problem_rows(s, d) -> DataFrame:
    p = D.problems(s, d).withColumn("h", G.F.greatest(F.abs(F.col("sx") - F.col("gx")), F.abs(F.col("sy") - F.col("gy"))))
    return p.select(F.concat(F.lit("f"), F.col("id") % 4).alias("file"), F.col("id").alias("row_id"), F.expr("cast(h div 4 as int)").alias("bucket"), F.lit("grid32.map").alias("map"), F.lit(32).alias("map_w"), F.lit(32).alias("map_h"), "sx", "sy", "gx", "gy", F.col("h").cast("double").alias("distance"))


def _problem_file(s, d) -> DataFrame:
    return R.parse_problems(R.lines(R.problem_text(_problem_rows(s, d))))


QUERIES = {
    "src01_map_round_trip": lambda s, d: _map(s, d).where("tile = '.'").select("x", "y"),
    "src10_problem_round_trip": lambda s, d: _problem_file(s, d).groupBy("file", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sx") + F.col("gy")).cast("long").alias("total"), F.max("precision").alias("digits")),
    "src21_stat_lines": lambda s, d: R.parse_stats(D.table(s, d, "events").select(F.lit("f").alias("file"), F.concat(F.lit("time of "), "event_type", F.lit(" : "), F.col("event_id").cast("string")).alias("value"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")),
}
ORACLES = {
    "src01_map_round_trip": f"WITH {D.CELLS_SQL} SELECT x, y FROM cells",
    "src10_problem_round_trip": f"WITH {D.PROBLEMS_SQL} SELECT 'f' || (id % 4) AS file, CAST(greatest(abs(sx-gx), abs(sy-gy)) // 4 AS INT) AS bucket, count(*) AS n, sum(sx+gy)::BIGINT AS total, 4 AS digits FROM problems GROUP BY 1, 2",
    "src21_stat_lines": "SELECT 'time of ' || event_type AS name, count(*) AS n, sum(event_id)::DOUBLE AS total FROM events GROUP BY 1",
}
