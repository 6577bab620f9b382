"""Grid maps as tables of open cells: successors, corners, clearances, jump points.

A map is (x, y) of its open cells, with more key columns in front where a table holds many maps. What is not in the
table is blocked, so the edge of a map needs no rule of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed-point costs of a straight and a diagonal step.
STRAIGHT, DIAGONAL = 10000, 14142
#: Order of the eight moves: clockwise from north; y grows to the south.
MOVES = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
#: One-hot numbers of the directions, by move.
FLAGS = {(0, -1): 1, (0, 1): 2, (1, 0): 4, (-1, 0): 8, (1, -1): 16, (-1, -1): 32, (1, 1): 64, (-1, 1): 128}


def moves(straight: int = STRAIGHT, diagonal: int = DIAGONAL, diagonals: bool = True) -> Column:
    """The moves as an array of (dx, dy, step), to be exploded beside each cell."""
    rows = [(dx, dy, diagonal if dx and dy else straight) for dx, dy in MOVES if diagonals or not (dx and dy)]
    return F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(s).cast("long").alias("step")) for dx, dy, s in rows))


def stepped(cells: DataFrame, steps: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    out = cells.select(*keys, "x", "y", F.explode(steps).alias("m"))
    return out.select(*keys, "x", "y", (F.col("x") + F.col("m.dx")).alias("x2"), (F.col("y") + F.col("m.dy")).alias("y2"), F.col("m.step").alias("cost"))


def _open_at(rows: DataFrame, cells: DataFrame, at: tuple[str, str], keys: tuple[str, ...]) -> DataFrame:
    there = cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("x").alias("_x"), F.col("y").alias("_y"))
    on = (F.col(at[0]) == F.col("_x")) & (F.col(at[1]) == F.col("_y"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(there, on, "left_semi")


def arcs(cells: DataFrame, diagonals: bool = True, cut_corners: bool = False, straight: int = STRAIGHT, diagonal: int = DIAGONAL, keys: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, x2, y2, cost): legal moves between open cells. A diagonal needs both cells beside it, unless corners may
    be cut. All joins are on equal cells: no range is joined, whatever the map's size."""
    out = _open_at(stepped(cells, moves(straight, diagonal, diagonals), keys), cells, ("x2", "y2"), keys)
    if diagonals and not cut_corners:  # beside a straight move lie its own two cells, so one rule holds for all
        out = _open_at(_open_at(out, cells, ("x2", "y"), keys), cells, ("x", "y2"), keys)
    return out


def weighted_arcs(cells: DataFrame, strict: bool = False) -> DataFrame:
    """(x, y, x2, y2, cost) over (x, y, cost): a straight move costs the mean of its two cells, a diagonal one that of
    the four it touches times sqrt 2, in whole numbers with a factor of 10000. `strict` bars a diagonal whose three
    other costs share no bit, as byte-wise tests of traversability do."""
    c = lambda n: cells.select(F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("cost").alias(n))
    out = stepped(cells, moves()).withColumnRenamed("cost", "step").join(cells.select("x", "y", F.col("cost").alias("own")), ["x", "y"])
    out = out.join(c("t"), (F.col("x2") == F.col("tx")) & (F.col("y2") == F.col("ty"))).join(c("a"), (F.col("x2") == F.col("ax")) & (F.col("y") == F.col("ay"))).join(c("b"), (F.col("x") == F.col("bx")) & (F.col("y2") == F.col("by")))
    if strict:
        out = out.where(F.expr("step = 10000 or (t & a & b) <> 0"))
    cost = F.when(F.col("step") == STRAIGHT, F.expr("(own + t) * 10000 div 2")).otherwise(F.expr("(own + t + a + b) * 14142 div 4"))
    return out.select("x", "y", "x2", "y2", cost.cast("long").alias("cost"))


def points(cells: DataFrame) -> DataFrame:
    """(px, py, n_open, corner, double_corner): the lattice points that touch an open cell. Point (px, py) is the upper
    left one of cell (px, py). A corner has one blocked cell; a double corner has two, across."""
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(bit).alias("bit")) for a, b, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))))
    rows = cells.select("x", "y", F.explode(corner).alias("c")).select((F.col("x") + F.col("c.a")).alias("px"), (F.col("y") + F.col("c.b")).alias("py"), "c.bit")
    mask = rows.groupBy("px", "py").agg(F.sum("bit").alias("mask"))
    return mask.select("px", "py", F.bit_count("mask").cast("long").alias("n_open"), F.col("mask").isin(7, 11, 13, 14).alias("corner"), F.col("mask").isin(6, 9).alias("double_corner"))


def point_arcs(cells: DataFrame) -> DataFrame:
    """(px, py, qx, qy, cost): moves between lattice points; a straight one needs an open cell on either side, a
    diagonal one the cell that it crosses. Double corners are not left."""
    p = points(cells)
    side = lambda ax, ay, bx, by, cost: F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("ax", "ay", "bx", "by", "cost"), (ax, ay, bx, by, cost))))
    edges = F.array(side(0, 0, 1, 0, STRAIGHT), side(0, 1, 1, 1, STRAIGHT), side(0, 0, 0, 1, STRAIGHT), side(1, 0, 1, 1, STRAIGHT), side(0, 0, 1, 1, DIAGONAL), side(1, 0, 0, 1, DIAGONAL))
    e = cells.select("x", "y", F.explode(edges).alias("e"))
    go = e.select((F.col("x") + F.col("e.ax")).alias("px"), (F.col("y") + F.col("e.ay")).alias("py"), (F.col("x") + F.col("e.bx")).alias("qx"), (F.col("y") + F.col("e.by")).alias("qy"), F.col("e.cost").alias("cost"))
    both = go.unionByName(go.select(F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"), "cost"))
    return both.distinct().join(p.where("not double_corner").select("px", "py"), ["px", "py"], "left_semi").select("px", "py", "qx", "qy", "cost")


def subgoals(cells: DataFrame) -> DataFrame:
    """Open cells at a convex corner: a diagonal cell is blocked and the two cells between are open."""
    diagonals = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in MOVES if dx and dy))
    out = cells.select("x", "y", F.explode(diagonals).alias("m")).select("x", "y", (F.col("x") + F.col("m.dx")).alias("x2"), (F.col("y") + F.col("m.dy")).alias("y2"))
    out = _open_at(_open_at(out, cells, ("x2", "y"), ()), cells, ("x", "y2"), ())
    there = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    return out.join(there, ["x2", "y2"], "left_anti").select("x", "y").distinct()


def around(cells: DataFrame) -> DataFrame:
    """(x, y, mask): which of the eight cells around are open, as direction flags."""
    flags = F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(f).cast("long").alias("flag")) for (dx, dy), f in FLAGS.items()))
    # an open cell tells its neighbours: one aggregate, no join
    told = cells.select("x", "y", F.explode(flags).alias("m")).select((F.col("x") - F.col("m.dx")).alias("x"), (F.col("y") - F.col("m.dy")).alias("y"), "m.flag")
    return cells.join(told.groupBy("x", "y").agg(F.sum("flag").alias("mask")), ["x", "y"], "left").select("x", "y", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))


def forced(cells: DataFrame) -> DataFrame:
    """(x, y, dir, forced): for arrival by a straight move, the flags of neighbours that the move's symmetry does not
    reach, without corner cutting: past a blocked cell beside the cell before, the open cell beside and the one ahead
    of that."""
    a = around(cells)
    out = []
    for (dx, dy), flag in FLAGS.items():
        if dx and dy:
            continue
        sides = [(dy, dx), (-dy, -dx)]
        has = lambda d: (F.col("mask").bitwiseAND(FLAGS[d]) > 0)
        f = F.lit(0)
        for sx, sy in sides:
            behind, beside, ahead = (sx - dx, sy - dy), (sx, sy), (sx + dx, sy + dy)
            f = f + F.when(~has(behind) & has(beside), F.lit(FLAGS[beside]) + F.when(has(ahead) & has((dx, dy)), F.lit(FLAGS[ahead])).otherwise(0)).otherwise(0)
        out.append(a.select("x", "y", F.lit(flag).alias("dir"), f.cast("long").alias("forced")).where((F.col("forced") > 0) & has((-dx, -dy))))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows


def clearance(cells: DataFrame, dx: int, dy: int) -> DataFrame:
    """(x, y, clearance): open cells in a row before (x, y), against the direction (dx, dy). A run is a group of cells
    whose place along the line grows as fast as their number in it."""
    along = F.col("x") if dx else F.col("y")
    step = dx or dy
    line = [F.col("y")] if dx and not dy else [F.col("x")] if not dx else [F.col("x") - F.col("y")] if dx == dy else [F.col("x") + F.col("y")]
    order = along * step
    w = Window.partitionBy(*line).orderBy(order)
    g = cells.withColumn("_line", line[0]).withColumn("_run", order - F.row_number().over(w))
    return g.select("x", "y", (F.row_number().over(Window.partitionBy("_line", "_run").orderBy(order)) - 1).cast("long").alias("clearance"))


def cardinal_jumps(cells: DataFrame) -> DataFrame:
    """(x, y, dir, jx, jy, steps): the next cell in a straight line that has a forced neighbour; rows only where there
    is one before a blocked cell."""
    f = forced(cells)
    out = None
    for (dx, dy), flag in FLAGS.items():
        if dx and dy:
            continue
        order = F.col("x") * dx if dx else F.col("y") * dy
        line = F.col("y") if dx else F.col("x")
        c = cells.withColumn("_line", line).withColumn("_run", order - F.row_number().over(Window.partitionBy(line).orderBy(order)))
        c = c.join(f.where(F.col("dir") == flag).select("x", "y", F.lit(True).alias("stop")), ["x", "y"], "left")
        ahead = Window.partitionBy("_line", "_run").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
        at = F.first(F.when(F.col("stop"), F.struct("x", "y")), ignorenulls=True).over(ahead)
        c = c.withColumn("j", at).where("j is not null")
        rows = c.select("x", "y", F.lit(flag).alias("dir"), F.col("j.x").alias("jx"), F.col("j.y").alias("jy"), (F.abs(F.col("j.x") - F.col("x")) + F.abs(F.col("j.y") - F.col("y"))).alias("steps"))
        out = rows if out is None else out.unionByName(rows)
    return out


def diagonal_jumps(cells: DataFrame) -> DataFrame:
    """(x, y, dir, jx, jy, steps): the next cell on a diagonal from which a straight jump in one of the diagonal's two
    parts starts. A diagonal's run ends where a step is not legal."""
    straight = cardinal_jumps(cells).select("x", "y", "dir")
    steps = arcs(cells).where("cost = 14142")
    out = None
    for (dx, dy), flag in FLAGS.items():
        if not (dx and dy):
            continue
        stops = straight.where(F.col("dir").isin(FLAGS[(dx, 0)], FLAGS[(0, dy)])).select("x", "y").distinct().withColumn("stop", F.lit(True))
        legal = steps.where((F.col("x2") - F.col("x") == dx) & (F.col("y2") - F.col("y") == dy)).select(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(True).alias("entered"))
        line = F.col("x") - F.col("y") if dx == dy else F.col("x") + F.col("y")
        c = cells.withColumn("_line", line).join(legal, ["x", "y"], "left").join(stops, ["x", "y"], "left")
        order = F.col("x") * dx
        # a cell that no legal step enters begins a run
        c = c.withColumn("_run", F.sum(F.when(F.col("entered"), 0).otherwise(1)).over(Window.partitionBy("_line").orderBy(order)))
        ahead = Window.partitionBy("_line", "_run").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
        c = c.withColumn("j", F.first(F.when(F.col("stop"), F.struct("x", "y")), ignorenulls=True).over(ahead)).where("j is not null")
        rows = c.select("x", "y", F.lit(flag).alias("dir"), F.col("j.x").alias("jx"), F.col("j.y").alias("jy"), F.abs(F.col("j.x") - F.col("x")).alias("steps"))
        out = rows if out is None else out.unionByName(rows)
    return out


def jump_labels(cells: DataFrame) -> DataFrame:
    """All eight directions' jumps: the table that searches over precomputed jump points read."""
    return cardinal_jumps(cells).unionByName(diagonal_jumps(cells))


def entrances(cells: DataFrame, size: int = 10, wide: int = 6) -> DataFrame:
    """(border, start, length, at): crossings of the vertical borders between clusters of `size` columns. A run of open
    pairs of cells is crossed in its middle, or at both ends if it is `wide` or longer."""
    left = cells.where((F.col("x") + 1) % size == 0)
    pairs = left.join(cells.select((F.col("x") - 1).alias("x"), "y"), ["x", "y"], "left_semi")
    run = F.col("y") - F.row_number().over(Window.partitionBy("x").orderBy("y"))
    runs = pairs.withColumn("run", run).groupBy("x", "run").agg(F.min("y").alias("start"), F.count(F.lit(1)).alias("length"))
    at = F.when(F.col("length") >= wide, F.array(F.col("start"), F.col("start") + F.col("length") - 1)).otherwise(F.array(F.expr("start + length div 2")))
    return runs.select(F.col("x").alias("border"), "start", "length", F.explode(at).alias("at"))


def scaled(cells: DataFrame, side: int, to: int) -> DataFrame:
    """The map at another size: each new cell takes the state of the nearest old one."""
    target = cells.sparkSession.range(to).withColumnRenamed("id", "x").crossJoin(cells.sparkSession.range(to).withColumnRenamed("id", "y"))
    old = lambda c: F.expr(f"({c} * {side}) div {to}")
    t = target.select("x", "y", old("x").alias("ox"), old("y").alias("oy"))
    return t.join(cells.select(F.col("x").alias("ox"), F.col("y").alias("oy")), ["ox", "oy"], "left_semi").select("x", "y")


def enlarged(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell becomes factor x factor cells."""
    n = F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long"))
    out = cells.select("x", "y", F.explode(n).alias("i")).select("x", "y", "i", F.explode(n).alias("j"))
    return out.select((F.col("x") * factor + F.col("i")).alias("x"), (F.col("y") * factor + F.col("j")).alias("y"))


def picture(cells: DataFrame, width: int) -> DataFrame:
    """(y, row): lines of a map file, `.` open and `@` blocked; rows without any open cell are left out."""
    xs = F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))
    rows = cells.groupBy("y").agg(F.collect_set("x").alias("xs"))
    return rows.select("y", F.array_join(F.transform(xs, lambda i: F.when(F.array_contains("xs", i), F.lit(".")).otherwise(F.lit("@"))), "").alias("row"))


def ranked(nodes: DataFrame) -> DataFrame:
    """(node, rank): whole numbers from 0 in the order of the nodes, which are counted by ranges."""
    from .analytics import running_count

    return running_count(nodes, "node", F.lit(True), "n", 1 << 18).select("node", (F.col("n") - 1).alias("rank"))
