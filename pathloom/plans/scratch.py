"""Tables in the folder that all executors share, joins on hot keys, and numbers for equal rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of one key that go to one task, and keys at most that are dealt out to several.
HOT_ROWS, HOT_KEYS = 2_000, 100_000
#: Equal rows that a task makes again.
COPIES = 10_000
#: Rows of a file, about, where a table is known to be small beside the data.
FILE_ROWS = 100_000

_marked: set[str] = set()


def root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, under spark.checkpoint.dir. Where that is unset it is the warehouse,
    which on a cluster must then be in a store that executors share. It is deleted when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        own = hadoop.Path(base).getFileSystem(conf).getScheme() == "file"
        if own and not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    out = f"{base.rstrip('/')}/pathloom-{spark.sparkContext.applicationId}"
    if out not in _marked:
        path = hadoop.Path(out)
        fs = path.getFileSystem(conf)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(out)
    return out


def stored(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing. Of a table
    with no more than `rows` rows only so many files are written as these fill, however many tasks find them."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.repartition(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes every scratch table of this application; frames that still read them fail afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _marked.clear()


def spread_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, rows: int, by: list[str] | None = None) -> DataFrame:
    """The inner join on `on`, where one key may hold any share of left's rows and few of right's.

    left has at most `rows` rows; sizes has the columns of `on` and n, the rows of left with that key. A key is hot if it
    has more than HOT_ROWS rows and a HOT_KEYS-th of all, so that fewer than HOT_KEYS can be; these are sent to all tasks.
    Their rows go to as many tasks as they fill: by a hash of the columns `by` on the left, and once to each on the right."""
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    if rows <= limit:
        return left.join(right, on)
    hot = stored(sizes.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_tasks")), "hot", HOT_KEYS)
    if hot.isEmpty():
        return left.join(right, on)
    hot = F.broadcast(hot)
    salt = F.when(F.col("_tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(by or left.columns)), F.col("_tasks"))).cast("int")
    own = left.join(hot, on, "left").withColumn("_salt", salt).drop("_tasks")
    to = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")
    return own.join(to, [*on, "_salt"]).drop("_salt")


def numbered(rows: DataFrame, name: str = "_copy") -> DataFrame:
    """rows with a number among those that are equal in all columns, from 0 without gaps.

    Equal rows cannot be told apart, so they are counted, which begins within each task, and then made again, COPIES at a
    time by different tasks."""
    found = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "counted")
    few = found.where(F.col("_n") <= COPIES).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = found.where(F.col("_n") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition("_from", *rows.columns).withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, F.col("_n")) - 1)))
    return few.select(*rows.columns, name).unionByName(many.select(*rows.columns, name))
