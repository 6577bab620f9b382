"""Stat logs and unit histories as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.scratch import root


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result table. Batches are written to the shared folder, the whole
    result of the last one, or, unless the mode is complete, those of all."""
    path = f"{root(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The table's files as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    out = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/{table}.parque[t]")
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out  # event time needs a zone


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def log_totals(log: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Running sum, count and last value per category and owner of a log stream; exclusion wins."""
    keep = F.lit(True)
    if include:
        keep = keep & F.col("category").isin(include)
    if exclude:
        keep = keep & ~F.col("category").isin(exclude)
    return log.where(keep).groupBy("category", "owner").agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n"), F.max_by("value", "seq").alias("last"))


def ticks(events: DataFrame, every: str) -> DataFrame:
    """What happens in each tick of a clock; units that act in it count once each."""
    return events.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def windows(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """An extension: sliding windows by event time, with rows dropped that are later than `late`."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """An extension: runs of a unit's events without a pause of `gap`."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def simulated(units: DataFrame, speed: str = "value") -> DataFrame:
    """A batch replay of the event loop: each unit acts at the running sum of its own waits. (unit, seq, t, distance)."""
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = units.withColumn("t", F.round(F.sum(speed).over(w), 6))
    back = Window.partitionBy("unit").orderBy("seq")
    step = F.sqrt((F.col("x") - F.lag("x").over(back)) * (F.col("x") - F.lag("x").over(back)) + (F.col("y") - F.lag("y").over(back)) * (F.col("y") - F.lag("y").over(back)))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return rows.select("unit", "seq", "t", F.round(F.sum("step").over(w), 6).alias("distance"))


def unit_states(events: DataFrame) -> DataFrame:
    """(unit, seq, n, t): each unit's clock and number of actions, kept as state from one batch to the next. Events of a
    unit within a batch act in the order of seq; one row per unit and batch comes out."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def act(key: tuple, batches, state: GroupState):
        n, t, last = state.get if state.exists else (0, 0.0, -1)
        for batch in batches:
            batch = batch.sort_values("seq")
            n, t, last = n + len(batch), t + float(batch["value"].sum()), max(last, int(batch["seq"].max()))
        state.update((n, t, last))
        yield pd.DataFrame({"unit": [key[0]], "seq": [last], "n": [n], "t": [round(t, 6)]})

    rows = events.select(F.col("user_id").alias("unit"), F.col("event_id").alias("seq"), "value")
    return rows.groupBy("unit").applyInPandasWithState(act, "unit long, seq long, n long, t double", "n long, t double, last long", "update", GroupStateTimeout.NoTimeout)


#: Open cells that a task of walks may hold.
MOST_CELLS = 2_000_000


def walks(cells: DataFrame, units: DataFrame, policy: str, steps: int) -> DataFrame:
    """(id, k, x, y, d) of units (id, x, y) that begin facing north (d 0; east 1, south 2, west 3) and take up to `steps`
    moves. right_hand: the first open cell of right, ahead, left, back. billiard: ahead, or back where that is blocked. A
    unit that cannot move ends. Units do not see each other."""
    import pandas as pd

    held = cells.select("x", "y").limit(MOST_CELLS + 1).toPandas()
    if len(held) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    open_ = cells.sparkSession.sparkContext.broadcast(set(zip(held["x"].tolist(), held["y"].tolist())))
    turns = {"right_hand": (1, 0, 3, 2), "billiard": (0, 2)}[policy]

    def walk(batches):
        moves = ((0, -1), (1, 0), (0, 1), (-1, 0))
        for batch in batches:
            rows = []
            for i, x, y in batch[["id", "x", "y"]].itertuples(index=False, name=None):
                d = 0
                rows.append((i, 0, x, y, d))
                for k in range(1, steps + 1):
                    way = next((e for e in ((d + t) % 4 for t in turns) if (x + moves[e][0], y + moves[e][1]) in open_.value), None)
                    if way is None:
                        break
                    d, x, y = way, x + moves[way][0], y + moves[way][1]
                    rows.append((i, k, x, y, d))
            yield pd.DataFrame(rows, columns=["id", "k", "x", "y", "d"])

    return units.select("id", "x", "y").mapInPandas(walk, "id long, k long, x long, y long, d long")
