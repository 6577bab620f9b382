"""Any-angle paths on grid maps by intervals that are propagated row by row.

From a root, a point of the lattice, an interval of each line of the lattice is seen. It is kept as two slopes, fractions
of whole numbers, so that it means the same on every later line, and with the run of open cells through which it came. A
round takes the intervals of all roots across one more row: each meets the runs of that row, is cut to what can pass them,
and ends where nothing can. What the intervals see of corners and ends are the arcs of the search, in which a path turns at
corners only. No task holds a map, and a map has no greatest size.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scratch import discard, stored

#: Width of the bins by which intervals meet runs and points, in cells.
BIN = 16
#: Rows that are crossed between two written tables.
ROWS = 8
#: Lengths that differ by less are equal.
NEAR = 1e-9


def runs(cells: DataFrame) -> DataFrame:
    """(row, a, b): the maximal runs of open cells of each row, from lattice line a to b."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x"))
    return cells.select("x", "y", run.alias("run")).groupBy("y", "run").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b")).select(F.col("y").alias("row"), "a", "b")


def surroundings(cells: DataFrame) -> DataFrame:
    """(x, y, near): the points of the lattice that touch open cells. near has a bit for each open cell: 1 right above,
    2 left above, 4 right below and 8 left below, where above is towards greater y."""
    touching = F.explode(F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), F.lit(bit).alias("bit")) for a, b, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)))))
    return cells.select(touching.alias("p")).groupBy("p.x", "p.y").agg(F.sum("p.bit").cast("int").alias("near"))


def corners(near: DataFrame) -> DataFrame:
    """(x, y, turn): the points at which one of four cells is blocked. turn is 1 where that cell lies right above or left
    below, else -1: a taut path passes the point along a direction whose dx * dy * turn is 0 at most."""
    return near.where(F.col("near").isin(7, 11, 13, 14)).select("x", "y", F.when(F.col("near").isin(14, 7), 1).otherwise(-1).alias("turn"))


def flat_arcs(near: DataFrame, cells: DataFrame, points: DataFrame) -> DataFrame:
    """(x, y, tx, ty): points (x, y) that follow each other on a line along x that may be walked: each step has an open
    cell on a side, and no point on the way lies between two cells that touch corner to corner."""
    steps = cells.select("x", F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y")).distinct()
    steps = steps.join(near.where("near in (6, 9)").select("x", "y", F.lit(1).alias("pinch")), ["x", "y"], "left")
    along = Window.partitionBy("y").orderBy("x")
    steps = steps.withColumn("fresh", F.when(F.col("pinch").isNull() & (F.lag("x").over(along) == F.col("x") - 1), 0).otherwise(1))
    steps = steps.withColumn("chain", F.sum("fresh").over(along))
    held = steps.select("x", "y", "chain", F.explode(F.array(F.col("x"), F.col("x") + 1)).alias("px"))
    held = held.select(F.col("px").alias("x"), "y", "chain").distinct().join(points.select("x", "y").distinct(), ["x", "y"])
    before = F.lag("x").over(Window.partitionBy("y", "chain").orderBy("x"))
    pairs = held.select("x", "y", before.alias("tx"), F.col("y").alias("ty")).where("tx is not null")
    return pairs.unionByName(pairs.select(F.col("tx").alias("x"), "y", F.col("x").alias("tx"), "ty"))


def _over(n: Column, d: Column, m: Column, e: Column) -> Column:
    """Whether n / d > m / e, for d, e > 0."""
    return n * e > m * d


def _bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def intervals(cells: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Tables (rx, ry, dy, d, a, b, ln, ld, rn, rd) by rising distance d of a line from the root: what roots (x, y, turn) see
    of it through the run from a to b, between the slopes ln / ld and rn / rd, in steps along x for each row. A root
    with a turn looks only where a taut path may lead."""
    strips = runs(cells).withColumn("low", F.expr(f"a div {BIN}"))
    strips = stored(strips.withColumn("bin", _bins(F.col("low"), F.expr(f"b div {BIN}"))), "strips")
    sides = roots.select(F.col("x").alias("rx"), F.col("y").alias("ry"), "turn", F.explode(F.array(F.lit(1), F.lit(-1))).alias("dy"))
    first = sides.withColumns({"row": F.col("ry") + F.when(F.col("dy") > 0, 0).otherwise(-1), "bin": F.expr(f"rx div {BIN}")}).join(strips, ["row", "bin"]).where("rx between a and b")
    left, right = F.col("a") - F.col("rx"), F.col("b") - F.col("rx")
    lean = F.coalesce(F.col("turn") * F.col("dy"), F.lit(0))  # slopes of its sign are not taut
    left, right = F.when(lean < 0, F.greatest(left, F.lit(0))).otherwise(left), F.when(lean > 0, F.least(right, F.lit(0))).otherwise(right)
    one = F.lit(1).cast("long")
    names = ["rx", "ry", "dy", "d", "a", "b", "ln", "ld", "rn", "rd"]
    now = first.withColumns({"d": one, "ln": left.cast("long"), "ld": one, "rn": right.cast("long"), "rd": one}).where("ln <= rn").select(names)
    out = [stored(now, "intervals")]
    while not out[-1].isEmpty():
        last = out[-1].agg(F.max("d")).first()[0]
        rows = [out[-1].where(F.col("d") == last)]
        for _ in range(ROWS):
            rows.append(_across(rows[-1], strips).persist())
        out.append(stored(functools.reduce(DataFrame.unionByName, rows[1:]), "intervals"))
        for row in rows[1:]:
            row.unpersist()
    return out


def _across(now: DataFrame, strips: DataFrame) -> DataFrame:
    """The intervals behind the next row."""
    at = now.withColumn("row", F.col("ry") + F.col("dy") * F.col("d") + F.when(F.col("dy") > 0, 0).otherwise(-1))
    at = at.withColumns({"from": F.expr(f"floor((rx * ld + ln * d) / (ld * {BIN}))"), "to": F.expr(f"floor((rx * rd + rn * d) / (rd * {BIN}))")}).withColumn("bin", _bins(F.col("from"), F.col("to")))
    met = at.join(strips.select("row", "bin", F.col("low"), F.col("a").alias("a2"), F.col("b").alias("b2")), ["row", "bin"]).where("bin = greatest(from, low)")
    met = met.where("greatest(a, a2) < least(b, b2)")  # runs that share a point alone touch corner to corner
    lo, hi = F.col("a2") - F.col("rx"), F.col("b2") - F.col("rx")
    lo_d, hi_d = F.when(lo > 0, F.col("d")).otherwise(F.col("d") + 1), F.when(hi > 0, F.col("d") + 1).otherwise(F.col("d"))
    tighter_l, tighter_r = _over(lo, lo_d, F.col("ln"), F.col("ld")), _over(F.col("rn"), F.col("rd"), hi, hi_d)
    new = met.select(
        "rx", "ry", "dy", (F.col("d") + 1).alias("d"), F.col("a2").alias("a"), F.col("b2").alias("b"),
        F.when(tighter_l, lo).otherwise(F.col("ln")).alias("ln"), F.when(tighter_l, lo_d).otherwise(F.col("ld")).alias("ld"),
        F.when(tighter_r, hi).otherwise(F.col("rn")).alias("rn"), F.when(tighter_r, hi_d).otherwise(F.col("rd")).alias("rd"),
    )
    return new.where(~_over(F.col("ln"), F.col("ld"), F.col("rn"), F.col("rd")))


def sight_arcs(cells: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(x, y, tx, ty, bent, ends, pinch, length): arcs between corners, from starts (x, y) to what they see, and into goals (x, y).
    bent and ends say whether the arc leads from and to a corner, pinch whether it leaves a point where blocked cells touch
    corner to corner, which no path passes. Arcs along x lead to the next point only; of the others
    those stay that a taut path can use, which at a corner goes round it."""
    near = stored(surroundings(cells), "near")
    own = stored(corners(near), "corners")
    null = F.lit(None).cast("int").alias("turn")
    ends = lambda df: df.select("x", "y").distinct().join(near.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", null)
    free = lambda df: df.groupBy("x", "y").agg(F.when(F.count("turn") == F.count(F.lit(1)), F.first("turn")).alias("turn"))
    roots, points = (stored(free(own.unionByName(ends(df))), "points") for df in (starts, goals))
    every = stored(free(own.unionByName(ends(starts)).unionByName(ends(goals))), "points")
    parts = intervals(cells, roots)
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part)
    seen = seen.withColumn("ty", F.col("ry") + F.col("dy") * F.col("d"))
    seen = seen.withColumn("bin", _bins(F.expr(f"floor((rx * ld + ln * d) / (ld * {BIN}))"), F.expr(f"floor((rx * rd + rn * d) / (rd * {BIN}))")))
    to = points.select(F.col("x").alias("tx"), F.col("y").alias("ty"), "turn", F.expr(f"x div {BIN}").alias("bin"))
    met = seen.join(to, ["ty", "bin"]).where("tx * ld >= rx * ld + ln * d and tx * rd <= rx * rd + rn * d")
    met = met.where("turn is null or (tx - rx) * (ty - ry) * turn <= 0").select(F.col("rx").alias("x"), F.col("ry").alias("y"), "tx", "ty").distinct()
    arcs = met.unionByName(flat_arcs(near, cells, every).select(F.col("x"), F.col("y"), "tx", "ty"))
    length = F.sqrt(((F.col("tx") - F.col("x")) * (F.col("tx") - F.col("x")) + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))).cast("double"))
    kind = lambda x, y, name: own.select(F.col("x").alias(x), F.col("y").alias(y), F.lit(True).alias(name))
    arcs = arcs.join(kind("x", "y", "bent"), ["x", "y"], "left").join(kind("tx", "ty", "ends"), ["tx", "ty"], "left")
    arcs = arcs.join(near.where("near in (6, 9)").select("x", "y", F.lit(True).alias("pinch")), ["x", "y"], "left")
    out = stored(arcs.select("x", "y", "tx", "ty", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("bent", "ends", "pinch")), length.alias("length")), "sight")
    discard(*parts)
    return out


def interval_lengths(cells: DataFrame, problems: DataFrame) -> DataFrame:
    """(id, length, legs) of problems (id, sx, sy, gx, gy) between points of the lattice: the length of a shortest path and
    the number of arcs that the search met it with; null where there is none.

    Equal problems are searched once, all at the same time. A round extends what fell in the last one; an offer stays if
    with the straight line to its goal it is below the best length known of its problem."""
    at = ["sx", "sy", "gx", "gy"]
    asked = stored(problems.select(*(F.col(c).cast("long").alias(c) for c in at)).distinct(), "asked")
    arcs = sight_arcs(cells, asked.select(F.col("sx").alias("x"), F.col("sy").alias("y")), asked.select(F.col("gx").alias("x"), F.col("gy").alias("y")))
    there = surroundings(cells).select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    rest = F.sqrt(((F.col("gx") - F.col("x")) * (F.col("gx") - F.col("x")) + (F.col("gy") - F.col("y")) * (F.col("gy") - F.col("y"))).cast("double"))
    frontier = asked.join(there, ["sx", "sy"], "left_semi").select(*at, F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0.0).alias("length"), F.lit(0).alias("legs"), F.lit(True).alias("fell"))
    reached = stored(frontier, "reached")
    frontier = reached
    while not frontier.isEmpty():
        best = reached.where("x = gx and y = gy").select(*at, F.col("length").alias("best"))
        # paths turn at corners only; along x they may pass other points
        ways = "(y = ty and not pinch) or (x = sx and y = sy) or bent"
        offers = frontier.drop("fell").join(arcs.withColumnRenamed("length", "step"), ["x", "y"]).where(ways).where("ends or y = ty or (tx = gx and ty = gy)")
        offers = offers.select(*at, F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("length") + F.col("step")).alias("length"), (F.col("legs") + 1).alias("legs"))
        offers = offers.join(best, at, "left").where((F.col("best").isNull()) | (F.col("length") + rest <= F.col("best") + NEAR)).drop("best")
        both = reached.select(*at, "x", "y", "length", "legs", F.col("length").alias("old")).unionByName(offers, allowMissingColumns=True)
        both = both.groupBy(*at, "x", "y").agg(F.min(F.struct("length", "legs")).alias("m"), F.min("old").alias("old"))
        fell = F.col("old").isNull() | (F.col("m.length") < F.col("old") - NEAR)
        before, reached = reached, stored(both.select(*at, "x", "y", "m.length", "m.legs", fell.alias("fell")), "reached")
        discard(before)
        frontier = reached.where("fell")
    found = reached.where("x = gx and y = gy").select(*at, "length", "legs")
    return problems.join(found, at, "left").select("id", "length", "legs")
