"""Any-angle paths over meshes of convex polygons by cones that are propagated polygon by polygon.

A root, a corner or an end of a problem, sees a cone through an edge that two polygons share. A round takes the cones of all
roots into the next polygons: each meets the shared edges of its polygon and is cut to what passes them. A cone lies between
two vertices of the mesh, so that no point of intersection is ever computed and whole coordinates stay exact. What the cones
see of corners and goals are the arcs of the search. No task holds a mesh, and a mesh has no greatest size.

Where obstacles touch at a vertex, the polygons round it fall into fans that are joined by shared edges. A fan is a node by
itself: paths turn within a fan and do not pass from one into another.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scratch import discard, stored
from .meshes import EPSILON, classified

#: Width of the bins by which vertices meet the edges on which they lie.
BIN = 4.0
#: Polygons that are crossed between two written tables.
STEPS = 4
#: Lengths that differ by less are equal.
NEAR = 1e-9
#: The fan of points at which polygons form one fan at most.
ONE = -1


def _cross(ox: str, oy: str, px: str, py: str, qx: str, qy: str) -> Column:
    """Above 0 where q lies left of the ray from o through p."""
    return F.expr(f"({px} - {ox}) * ({qy} - {oy}) - ({py} - {oy}) * ({qx} - {ox})")


def _distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.expr(f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))")


def _after(p: Column) -> Column:
    return F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))


def oriented(polygons: DataFrame) -> DataFrame:
    """(pid, points) counter-clockwise, whichever way they are given, without those of fewer than three points."""
    turn = F.aggregate(F.zip_with("points", _after(F.col("points")), lambda a, b: (a["x"] * b["y"] - a["y"] * b["x"]).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return polygons.where(F.size("points") > 2).select("pid", F.when(turn < 0, F.reverse("points")).otherwise(F.col("points")).alias("points"))


def half_edges(polygons: DataFrame) -> DataFrame:
    """(pid, ax, ay, bx, by): the edges of convex polygons (pid, points), counter-clockwise, and cut at each vertex of the mesh
    that lies on them."""
    ends = F.posexplode(F.zip_with("points", _after(F.col("points")), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by"))))
    edges = stored(polygons.select("pid", ends.alias("k", "e")).select("pid", "k", "e.*").where("ax <> bx or ay <> by"), "edges")
    binned = edges.withColumn("u", F.explode(F.expr(f"sequence(cast(floor(least(ax, bx) / {BIN}) as int), cast(floor(greatest(ax, bx) / {BIN}) as int))")))
    # the part of the edge over a bin in x lies in few bins in y
    at = lambda x: f"(case when ax = bx then null else ay + (by - ay) * ({x} - ax) / (bx - ax) end)"
    from_y, to_y = (at(f"{f}({g}(ax, bx), (u + {k}) * {BIN})") for f, g, k in (("greatest", "least", 0), ("least", "greatest", 1)))
    binned = binned.withColumns({"low": F.expr(f"coalesce(least({from_y}, {to_y}), least(ay, by)) - {EPSILON}"), "high": F.expr(f"coalesce(greatest({from_y}, {to_y}), greatest(ay, by)) + {EPSILON}")})
    binned = binned.withColumn("v", F.explode(F.expr(f"sequence(cast(floor(low / {BIN}) as int), cast(floor(high / {BIN}) as int))"))).drop("low", "high")
    vertices = edges.select(F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    vertices = vertices.select("x", "y", F.expr(f"cast(floor(x / {BIN}) as int)").alias("u"), F.expr(f"cast(floor(y / {BIN}) as int)").alias("v"))
    length, along = _distance("ax", "ay", "bx", "by"), F.expr("(x - ax) * (bx - ax) + (y - ay) * (by - ay)")
    cuts = binned.join(vertices, ["u", "v"]).where((F.abs(_cross("ax", "ay", "bx", "by", "x", "y")) <= EPSILON * length) & (along > 0) & (along < length * length) & F.expr("(x <> ax or y <> ay) and (x <> bx or y <> by)"))
    points = edges.select("pid", "k", "bx", "by", F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    points = points.unionByName(cuts.select("pid", "k", "bx", "by", along.alias("t"), "x", "y"))
    behind = Window.partitionBy("pid", "k").orderBy("t")
    nxt = lambda c, end: F.coalesce(F.lead(c).over(behind), F.col(end))
    return points.select("pid", F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x", "bx").alias("bx2"), nxt("y", "by").alias("by2")).withColumnsRenamed({"bx2": "bx", "by2": "by"})


def portals(halves: DataFrame) -> DataFrame:
    """(pid, to, ax, ay, bx, by): edges through which one polygon leads into another; pid lies left of a to b."""
    other = halves.select(F.col("pid").alias("to"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("ax"), F.col("by").alias("ay"))
    return halves.join(other, ["ax", "ay", "bx", "by"]).where("pid <> to").select("pid", "to", "ax", "ay", "bx", "by")


def fans(halves: DataFrame, ways: DataFrame) -> DataFrame:
    """(x, y, pid, fan): the polygons at the vertices where obstacles touch, with the least pid that is reached from each
    through shared edges at that vertex. A round tells neighbours, so there are as many as polygons in a fan."""
    rims = halves.join(ways, ["pid", "ax", "ay", "bx", "by"], "left_anti")
    several = rims.groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).count().where("count > 1").select("x", "y")
    at = lambda df, x, y, *more: df.select(F.col(x).alias("x"), F.col(y).alias("y"), *more)
    links = at(ways, "ax", "ay", "pid", "to").unionByName(at(ways, "bx", "by", "pid", "to")).join(several, ["x", "y"], "left_semi")
    links = stored(links.distinct(), "fan_links")
    now = stored(at(halves, "ax", "ay", "pid").join(several, ["x", "y"], "left_semi").withColumns({"fan": F.col("pid"), "fell": F.lit(True)}), "fans")
    while not now.where("fell").isEmpty():
        told = now.where("fell").join(links, ["x", "y", "pid"]).groupBy("x", "y", F.col("to").alias("pid")).agg(F.min("fan").alias("heard"))
        both = now.join(told, ["x", "y", "pid"], "left").withColumn("least", F.least("fan", "heard"))
        before, now = now, stored(both.select("x", "y", "pid", F.col("least").alias("fan"), (F.col("least") < F.col("fan")).alias("fell")), "fans")
        discard(before)
    return now.drop("fell")


def corners(halves: DataFrame, ways: DataFrame, parts: DataFrame) -> DataFrame:
    """(x, y, fan, px, py, nx, ny): vertices where the free angle of a fan is over 180 degrees, with the ends of the two edges
    of its obstacle there."""
    rims = halves.join(ways, ["pid", "ax", "ay", "bx", "by"], "left_anti")

    def fanned(x: str, y: str, ox: str, oy: str, names: list[str]) -> DataFrame:
        own = rims.select(F.col(x).alias("x"), F.col(y).alias("y"), "pid", F.col(ox).alias(names[0]), F.col(oy).alias(names[1]))
        return own.join(parts, ["x", "y", "pid"], "left").select("x", "y", F.coalesce("fan", F.lit(ONE)).alias("fan"), *names)

    both = fanned("bx", "by", "ax", "ay", ["px", "py"]).join(fanned("ax", "ay", "bx", "by", ["nx", "ny"]), ["x", "y", "fan"])
    return both.where(_cross("px", "py", "x", "y", "nx", "ny") < -EPSILON)


def cones(roots: DataFrame, ways: DataFrame) -> list[DataFrame]:
    """Tables (x, y, fan, pid, lx, ly, rx, ry, step): the polygons that roots (x, y, fan, pid) see through shared edges, between
    the rays through l and r. Edges that lie on a line with the root pass none; what lies behind them is seen at the border
    of a cone beside them, as is what lies behind a vertex."""
    inside = _cross("ax", "ay", "bx", "by", "x", "y") > EPSILON
    names = ["x", "y", "fan", "pid", "lx", "ly", "rx", "ry", "step"]
    first = roots.join(ways, "pid").where(inside).select("x", "y", "fan", F.col("to").alias("pid"), F.col("bx").alias("lx"), F.col("by").alias("ly"), F.col("ax").alias("rx"), F.col("ay").alias("ry"), F.lit(1).alias("step"))
    out = [stored(first, "cones")]
    left, right = _cross("x", "y", "lx", "ly", "bx", "by") < 0, _cross("x", "y", "rx", "ry", "ax", "ay") > 0

    def further(now: DataFrame) -> DataFrame:
        met = now.join(ways, "pid").where(inside)
        cut = lambda tighter, edge, old: F.when(tighter, F.col(edge)).otherwise(F.col(old))
        new = met.select(
            "x", "y", "fan", F.col("to").alias("pid"), cut(left, "bx", "lx").alias("lx"), cut(left, "by", "ly").alias("ly"),
            cut(right, "ax", "rx").alias("rx"), cut(right, "ay", "ry").alias("ry"), (F.col("step") + 1).alias("step"),
        )
        return new.where(_cross("x", "y", "rx", "ry", "lx", "ly") > EPSILON).select(names)

    while not out[-1].isEmpty():
        last = out[-1].agg(F.max("step")).first()[0]
        steps = [out[-1].where(F.col("step") == last)]
        for _ in range(STEPS):
            steps.append(further(steps[-1]).persist())
        out.append(stored(functools.reduce(DataFrame.unionByName, steps[1:]), "cones"))
        for s in steps[1:]:
            s.unpersist()
    return out


def sight_arcs(polygons: DataFrame, starts: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y, fan, tx, ty, tfan, bent, ends, length): from corners and starts (x, y) to the corners and goals that they see. bent
    and ends say whether a taut path may turn at the arc's source and target. Also (x, y, fan) of the starts in the mesh."""
    polygons = oriented(polygons)
    halves = stored(half_edges(polygons), "halves")
    ways = stored(portals(halves), "portals")
    parts = fans(halves, ways)
    turns = stored(corners(halves, ways, parts), "corners")
    fan = F.coalesce("fan", F.lit(ONE)).alias("fan")
    vertex = halves.select(F.col("ax").alias("x"), F.col("ay").alias("y"), "pid").join(parts, ["x", "y", "pid"], "left").select("x", "y", fan, "pid")
    own = vertex.join(turns.select("x", "y", "fan"), ["x", "y", "fan"], "left_semi")

    def placed(points: DataFrame) -> DataFrame:
        at = classified(points.select("x", "y").distinct().withColumn("id", F.struct("x", "y")), polygons)
        return at.select("id.x", "id.y", "pid").join(parts, ["x", "y", "pid"], "left").select("x", "y", fan, "pid")

    begun = stored(placed(starts), "starts")
    roots = stored(own.unionByName(begun).distinct(), "roots")
    targets = stored(own.unionByName(placed(goals)).distinct().withColumnsRenamed({"x": "tx", "y": "ty", "fan": "tfan"}), "targets")
    seen = roots.join(targets, "pid")
    layers = cones(roots, ways)
    for layer in layers:
        within = layer.join(targets, "pid").where((_cross("x", "y", "rx", "ry", "tx", "ty") >= -EPSILON) & (_cross("x", "y", "lx", "ly", "tx", "ty") <= EPSILON))
        seen = seen.select("x", "y", "fan", "tx", "ty", "tfan").unionByName(within.select("x", "y", "fan", "tx", "ty", "tfan"))
    arcs = seen.select("x", "y", "fan", "tx", "ty", "tfan").where("x <> tx or y <> ty").distinct()
    sides = lambda cx, cy: _cross("x", "y", "tx", "ty", cx, cy)
    for key, name in ((["x", "y", "fan"], "bent"), (["tx", "ty", "tfan"], "ends")):
        to = turns.withColumnsRenamed(dict(zip(["x", "y", "fan"], key)))
        taut = ~((F.least(sides("px", "py"), sides("nx", "ny")) < -EPSILON) & (F.greatest(sides("px", "py"), sides("nx", "ny")) > EPSILON))
        arcs = arcs.join(to, key, "left").withColumn(name, F.coalesce(taut, F.lit(False))).drop("px", "py", "nx", "ny")
    out = stored(arcs.withColumn("length", _distance("x", "y", "tx", "ty")), "sight")
    where = stored(begun.select("x", "y", "fan").distinct(), "starts")
    discard(*layers, roots, targets, begun)
    return out, where


def interval_lengths(polygons: DataFrame, problems: DataFrame) -> DataFrame:
    """(id, length, legs) of problems (id, sx, sy, gx, gy) over convex polygons (pid, points): the length of a shortest path and
    the number of straight legs that the search met it with; null where there is none or an end lies outside or is null.

    Equal problems are searched once, all at the same time; a round extends what fell in the last one. An offer stays if with
    the straight line to its goal it is below the best length known of its problem."""
    at, node = ["sx", "sy", "gx", "gy"], ["x", "y", "fan"]
    problems = problems.select("id", *(F.col(c).cast("double").alias(c) for c in at))
    asked = stored(problems.select(*at).dropna().distinct(), "asked")
    arcs, begun = sight_arcs(polygons, asked.selectExpr("sx as x", "sy as y"), asked.selectExpr("gx as x", "gy as y"))
    begun = asked.join(begun.withColumnsRenamed({"x": "sx", "y": "sy"}), ["sx", "sy"])
    reached = stored(begun.select(*at, F.col("sx").alias("x"), F.col("sy").alias("y"), "fan", F.lit(0.0).alias("length"), F.lit(0).alias("legs"), F.lit(True).alias("fell")), "reached")
    rest = _distance("x", "y", "gx", "gy")
    found = lambda df: df.where("x = gx and y = gy").groupBy(*at).agg(F.min(F.struct("length", "legs")).alias("m"))
    while not reached.where("fell").isEmpty():
        best = found(reached).select(*at, F.col("m.length").alias("best"))
        offers = reached.where("fell").drop("fell").join(arcs.withColumnRenamed("length", "leg"), node)
        offers = offers.where("(bent or legs = 0) and (ends or (tx = gx and ty = gy))")
        offers = offers.select(*at, F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tfan").alias("fan"), (F.col("length") + F.col("leg")).alias("length"), (F.col("legs") + 1).alias("legs"))
        offers = offers.join(best, at, "left").where(F.col("best").isNull() | (F.col("length") + rest <= F.col("best") + NEAR)).drop("best")
        both = reached.drop("fell").withColumn("old", F.col("length")).unionByName(offers, allowMissingColumns=True)
        both = both.groupBy(*at, *node).agg(F.min(F.struct("length", "legs")).alias("m"), F.min("old").alias("old"))
        fell = F.col("old").isNull() | (F.col("m.length") < F.col("old") - NEAR)
        before, reached = reached, stored(both.select(*at, *node, "m.length", "m.legs", fell.alias("fell")), "reached")
        discard(before)
    return problems.join(found(reached).select(*at, "m.length", "m.legs"), at, "left").select("id", "length", "legs")
