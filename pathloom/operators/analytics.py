"""Analysis of experiment results: summaries, buckets, outliers, roll-ups, ratios, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def r6(c: Column) -> Column:
    return F.round(c, 6)


def stat_summary(log: DataFrame) -> DataFrame:
    """Per category and owner: sum, max, count, mean and population deviation."""
    v = F.col("value")
    return log.groupBy("category", "owner").agg(r6(F.sum(v)).alias("total"), F.max(v).alias("top"), F.count(v).alias("n"), r6(F.coalesce(F.avg(v), F.lit(0.0))).alias("mean"), r6(F.coalesce(F.stddev_pop(v), F.lit(0.0))).alias("sd"))


def bucketed_average(df: DataFrame, dist: str, value: str, step: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, count and sample deviation of `value` in buckets of `dist` from 1 on; (mid, mean, n, sd)."""
    k = F.floor((F.col(dist) - 1) / step)
    rows = df.where(F.col(dist) >= 1).groupBy(*by, k.alias("k"))
    out = rows.agg(r6(F.avg(value)).alias("mean"), F.count(F.lit(1)).alias("n"), r6(F.stddev_samp(value)).alias("sd"))
    return out.select(*by, (1 + F.col("k") * step + step / 2).alias("mid"), "mean", "n", "sd")


def grouped_summary(df: DataFrame, by: str, value: str, cutoff: int = 1, drop_outliers: bool = False) -> DataFrame:
    """Six numbers, count and sample deviation per group; groups under `cutoff` rows go."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    if drop_outliers:
        rows = without_outliers(rows, by, value)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), q.alias("q"), r6(F.avg(value)).alias("mean"), F.max(value).alias("high"), r6(F.stddev_samp(value)).alias("sd"))
    return out.where(F.col("n") >= cutoff).select(by, "n", "low", r6(F.col("q")[0]).alias("q1"), r6(F.col("q")[1]).alias("median"), "mean", r6(F.col("q")[2]).alias("q3"), "high", "sd")


def hinges(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, lower, upper, iqr): Tukey's hinges, and the range between interpolated quartiles."""
    w = Window.partitionBy(by)
    rows = df.select(by, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    depth = F.floor((F.col("n") + 3) / 2) / 2
    at = lambda d: F.avg(F.when(F.col("rn").isin(F.floor(d), F.ceil(d)), F.col("v")))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.groupBy(by).agg(at(depth).alias("lower"), at(F.col("n") + 1 - depth).alias("upper"), q.alias("q"))
    return out.select(by, "lower", "upper", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))


def without_outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows within 1.5 ranges of the hinges of their group."""
    h = hinges(df, by, value)
    inside = (F.col(value) >= F.col("lower") - 1.5 * F.col("iqr")) & (F.col(value) <= F.col("upper") + 1.5 * F.col("iqr"))
    return df.join(h, by).where(inside).select(df.columns)


def chunk_means(df: DataFrame, order: str, value: str, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each `size` consecutive rows; null for a last chunk that is not full."""
    k = F.expr(f"(row_number() over (partition by {', '.join(by) or '1'} order by {order}) - 1) div {size}")
    out = df.withColumn("chunk", k).groupBy(*by, "chunk").agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "chunk", F.when(F.col("n") == size, r6(F.col("m"))).alias("mean"))


def weighted_rollup(leaves: DataFrame, levels: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of the leaves at each level of a tree, all in one."""
    out = leaves.rollup(*levels).agg(r6(F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"), F.sum(weight).alias("weight"))
    return out.select(*levels, "value", "weight")


def nested_means(leaves: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Unweighted mean of the children at each level: a level's rows come from the level below."""
    out, rows = None, leaves.groupBy(*levels).agg(F.avg(value).alias("value"))
    for n in range(len(levels), -1, -1):
        if n < len(levels):
            rows = rows.groupBy(*levels[:n]).agg(F.avg("value").alias("value"))
        level = rows.select(*levels[:n], *(F.lit(None).cast("string").alias(x) for x in levels[n:]), r6(F.col("value")).alias("value"))
        out = level if out is None else out.unionByName(level)
    return out


def empirical_rule(df: DataFrame, value: str) -> DataFrame:
    """Share of rows within one, two and three sample deviations of the mean."""
    s = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    away = F.abs(F.col(value) - F.col("m"))
    return df.crossJoin(F.broadcast(s)).agg(*(r6(100 * F.avg((away <= k * F.col("s")).cast("int"))).alias(f"within_{k}") for k in (1, 2, 3)))


def empirical_distribution(df: DataFrame, value: str, step: float) -> DataFrame:
    from ..functions.scalars import round_to_nearest

    n = df.groupBy(round_to_nearest(F.col(value), step).alias("value")).agg(F.count(F.lit(1)).alias("freq"))
    return n.crossJoin(n.agg(F.sum("freq").alias("all"))).select("value", "freq", r6(F.col("freq") / F.col("all")).alias("probability"))


def speedup(base: DataFrame, target: DataFrame, on: list[str], value: str) -> DataFrame:
    return base.select(*on, F.col(value).alias("b")).join(target.select(*on, F.col(value).alias("t")), on).select(*on, r6(F.try_divide(F.col("b"), F.col("t"))).alias("speedup"))


def discrepancies(a: DataFrame, b: DataFrame, on: str, value: str, eps: float = 1e-8) -> DataFrame:
    rows = a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on)
    return rows.where(F.abs(F.col("a") - F.col("b")) > eps)


def ratio_to_baseline(stats: DataFrame, baseline: str) -> DataFrame:
    """(benchmark, stat, alg, ratio) over (benchmark, stat, alg, value); 0 where an algorithm's value is not above 0."""
    b = stats.where(F.col("alg") == baseline).select("benchmark", "stat", F.col("value").alias("b"))
    return stats.join(b, ["benchmark", "stat"]).select("benchmark", "stat", "alg", F.when(F.col("value") > 0, r6(F.col("b") / F.col("value"))).otherwise(F.lit(0.0)).alias("ratio"))


def combined(stats: DataFrame, left: str, op: str, right: str, name: str) -> DataFrame:
    """A new statistic from two by + - * or /, which gives null over 0."""
    p = stats.groupBy("benchmark", "alg").pivot("stat", [left, right]).agg(F.first("value"))
    a, b = F.col(left), F.col(right)
    return p.select("benchmark", "alg", F.lit(name).alias("stat"), r6({"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]).alias("value"))


def report(stats: DataFrame) -> DataFrame:
    """Per algorithm over (alg, dist, best, time): counts of valid and of suboptimal results, lengths, suboptimality."""
    s = stats.withColumn("subopt", F.try_divide(F.col("dist"), F.col("best"))).withColumn("ok", F.col("dist").isNotNull())
    return s.groupBy("alg").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"), F.count_if(F.col("subopt") >= 1.001).alias("n_subopt"), r6(F.avg("dist")).alias("avg_length"),
        r6(F.avg("subopt")).alias("avg_subopt"), r6(F.max("subopt")).alias("max_subopt"), r6(F.sum("dist") / F.sum(F.try_divide(F.col("dist"), F.col("subopt")))).alias("overall_subopt"), r6(F.avg("time") * 1000).alias("avg_ms"),
    )


def last_values(log: DataFrame) -> DataFrame:
    return log.groupBy("category", "owner").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def neighbours_in_log(log: DataFrame, start: int) -> DataFrame:
    """(category, next_seq, prev_seq): the first entry from `start` on and the last up to it; entry 0 is no earlier one."""
    return log.groupBy("category").agg(F.min(F.when(F.col("seq") >= start, F.col("seq"))).alias("next_seq"), F.max(F.when((F.col("seq") <= start) & (F.col("seq") > 0), F.col("seq"))).alias("prev_seq"))


def running_sums(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("category", "owner").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("seq", "category", "owner", r6(F.sum("value").over(w)).alias("running"))


def passes(log: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Exclusion wins; an empty list of inclusions lets all in."""
    keep = ~F.col("category").isin(exclude) if exclude else F.lit(True)
    return log.where(keep & (F.col("category").isin(include) if include else F.lit(True)))


def running_count(df: DataFrame, order: str, flag: Column, name: str, width: int = 1 << 20) -> DataFrame:
    """How often flag held up to each row, by a whole-number order: counts of ranges first, then within each range, so
    that no task sees the whole table."""
    d = df.withColumn("_range", F.expr(f"{order} div {width}")).withColumn("_flag", F.when(flag, 1).otherwise(0))
    ranges = d.groupBy("_range").agg(F.sum("_flag").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", before.alias("_before"))
    own = F.sum("_flag").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_own", own).join(ranges, "_range").withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def session_ratios(log: DataFrame, marker: str, top: str, below: str) -> DataFrame:
    """Mean ratio of two statistics between marker entries; the n-th of one is paired with the n-th of the other."""
    s = running_count(log, "seq", F.col("category") == marker, "session")
    s = s.where(F.col("category").isin(top, below)).withColumn("k", F.row_number().over(Window.partitionBy("session", "category").orderBy("seq")))
    t, b = (s.where(F.col("category") == c).select("session", "k", F.col("value").alias(n)) for c, n in ((top, "t"), (below, "b")))
    return t.join(b, ["session", "k"]).where("b <> 0").groupBy("session").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("t") / F.col("b"))).alias("ratio"))


def length_classes(df: DataFrame, length: str, time: str, ends: tuple[int, ...] = (150, 300, 500, 750, 1200)) -> DataFrame:
    c = F.when(F.col(length) <= ends[0], 0)
    for i, e in enumerate(ends[1:], 1):
        c = c.when(F.col(length) <= e, i)
    return df.groupBy(c.otherwise(len(ends)).alias("class")).agg(F.count(F.lit(1)).alias("calls"), r6(F.sum(time)).alias("total_time"))


def asof(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """The move of the last run that begins at or before each target: (source, target, move)."""
    u = keys.select("source", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("move"))
    u = u.unionByName(runs.select("source", F.col("run_begin").alias("at"), F.lit(0).alias("kind"), F.col("move").cast("long").alias("move")))
    w = Window.partitionBy("source").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("found", F.last("move", ignorenulls=True).over(w)).where("kind = 1").select("source", F.col("at").alias("target"), F.col("found").alias("move"))


def applied(df: DataFrame, by: str, value: str, fun, kind: str = "double") -> DataFrame:
    """(by, value): any function of a group's values, a pandas series, in the group's own task. For sums and extremes use
    aggregates, which begin before the groups are brought together."""
    import pandas as pd

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [part[by].iloc[0]], "value": [fun(part[value])]})

    return df.select(by, value).groupBy(by).applyInPandas(one, f"{by} {df.schema[by].dataType.simpleString()}, value {kind}")
