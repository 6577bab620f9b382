"""Maps, problems and measurements derived from the given tables; each function has its SQL form beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """(x, y, q): all cells that the line items hit; a cell is open where q % 4 <> 0."""
    l = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % side, (F.col("l_orderkey") * 5 + F.col("l_suppkey")) % side
    return l.groupBy(x.alias("x"), y.alias("y")).agg(F.sum("l_quantity").cast("long").alias("q"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y): the open cells."""
    return grid(spark, sf_dir).where("q % 4 <> 0").select("x", "y")


def weighted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, cost): open cells with costs of 46 to 85."""
    return grid(spark, sf_dir).where("q % 4 <> 0").select("x", "y", (46 + F.col("q") % 40).alias("cost"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sx, sy, gx, gy) from orders."""
    o, m = table(spark, sf_dir, "orders"), SIDE
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % m).alias("sx"), (F.col("o_custkey") % m).alias("sy"),
        (F.col("o_orderkey") * 3 % m).alias("gx"), (F.col("o_custkey") * 11 % m).alias("gy"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alg, instance, run, time, dist): results of runs of five algorithms, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("alg"), F.col("user_id").alias("instance"), (F.col("event_id") % 3).alias("run"),
        F.col("event_id").alias("seq"), F.col("value").alias("time"), (F.col("event_id") % 997 / 10.0).alias("dist"),
    )


def stat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, category, owner, value): an append-only log, from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("category"), (F.col("user_id") % 7).alias("owner"), F.col("value"))


GRID_SQL = "h AS (SELECT (l_partkey*7+l_linenumber)%32 AS x, (l_orderkey*5+l_suppkey)%32 AS y, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"
CELLS_SQL = GRID_SQL + ", cells AS (SELECT x, y FROM h WHERE q % 4 <> 0)"
WEIGHTED_SQL = GRID_SQL + ", wcells AS (SELECT x, y, 46 + q % 40 AS cost FROM h WHERE q % 4 <> 0)"
PROBLEMS_SQL = "problems AS (SELECT o_orderkey AS id, o_orderkey%32 AS sx, o_custkey%32 AS sy, (o_orderkey*3)%32 AS gx, (o_custkey*11)%32 AS gy FROM orders)"
MEASUREMENTS_SQL = "m AS (SELECT event_type AS alg, user_id AS instance, event_id % 3 AS run, event_id AS seq, value AS time, event_id % 997 / 10.0 AS dist FROM events)"
STAT_LOG_SQL = "log AS (SELECT event_id AS seq, event_type AS category, user_id % 7 AS owner, value FROM events)"
