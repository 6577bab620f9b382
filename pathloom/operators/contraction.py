"""Graphs of subgoals in many levels: a node goes when all paths over it stay among nodes that reach each other directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import search
from ..plans.scratch import discard
from . import hierarchies as K
from .abstraction import goal_of, start_of
from .paths import hierarchy_costs


def _needed(a: DataFrame) -> DataFrame:
    """(source, target, cost, mid): pairs whose only shortest way is over mid. Where two ways of two arcs are as short, or an
    arc is, none of them is needed."""
    first, second = a.select("source", F.col("target").alias("m"), F.col("cost").alias("c1")), a.select(F.col("source").alias("m"), "target", F.col("cost").alias("c2"))
    ways = first.join(second, "m").where("source <> target").select("source", "target", "m", (F.col("c1") + F.col("c2")).alias("cost"))
    ways = ways.groupBy("source", "target", "cost").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("mid"))
    ways = ways.groupBy("source", "target").agg(F.min(F.struct("cost", "n", "mid")).alias("b")).where("b.n = 1").select("source", "target", "b.cost", "b.mid")
    return ways.join(a.select("source", "target", F.col("cost").alias("now")), ["source", "target"], "left").where("now is null or now > cost").drop("now")


def _without(a: DataFrame, out: DataFrame) -> DataFrame:
    return a.join(out.select(F.col("node").alias("source")), "source", "left_anti").join(out.select(F.col("node").alias("target")), "target", "left_anti")


def _removed(a: DataFrame, out: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes that go, shortcuts, arcs that stay) of candidates `out` (node, r), no two of them neighbours. Ways over two
    candidates may each have made the other's shortcut needless: if that would be no direct one, the later of them stays."""
    rest = search.scratch(_without(a, out))
    first = a.select("source", F.col("target").alias("node"), F.col("cost").alias("c1")).join(out, "node")
    ways = first.join(a.select(F.col("source").alias("node"), "target", F.col("cost").alias("c2")), "node").where("source <> target").select("source", "target", "node", "r", (F.col("c1") + F.col("c2")).alias("cost"))
    ways = search.scratch(ways)
    pairs = ways.groupBy("source", "target").agg(F.min("cost").alias("least"))
    two = pairs.join(rest.select("source", F.col("target").alias("x"), F.col("cost").alias("c1")), "source").join(rest.select(F.col("source").alias("x"), "target", F.col("cost").alias("c2")), ["x", "target"])
    other = two.select("source", "target", (F.col("c1") + F.col("c2")).alias("c")).unionByName(rest.select("source", "target", F.col("cost").alias("c"))).groupBy("source", "target").agg(F.min("c").alias("other"))
    lost = ways.join(pairs, ["source", "target"]).where("cost = least").join(other, ["source", "target"], "left").where("other is null or other > cost")
    lost = search.scratch(lost.select("source", "target", "node", "r", "cost"))
    stay = lost.where(F.col("cost") > K._straight("source", "target")).groupBy("source", "target").agg(F.max("r").alias("r")).select("r.node").distinct()
    goes = search.scratch(out.select("node").join(stay, "node", "left_anti"))
    short = lost.where(F.col("cost") == K._straight("source", "target")).join(goes, "node", "left_semi").groupBy("source", "target").agg(F.min("cost").alias("cost"), F.min("node").alias("mid"))
    return goes, search.scratch(short), search.scratch(_without(a, goes))


def r_contracted(arcs: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(levels (node, level), arcs (source, target, cost, mid)) of undirected arcs (source, target, cost) between nodes of a map.

    A node may go if each shortcut that it leaves behind is as long as the octile distance of its ends, so that a path over it
    is still followed without a search. A round removes nodes of less rank than their neighbours. The nodes left in the end, or after `most` rounds, are the highest level; only there
    do arcs join nodes of one level. Each round is joins on nodes; what it holds is the arcs met end to end."""
    a = search.scratch(arcs.groupBy("source", "target").agg(F.min("cost").alias("cost")).select("source", "target", "cost", F.lit(None).cast("long").alias("mid")))
    every, gone, level = a, None, 0
    while most is None or level < most:
        need = search.scratch(_needed(a))
        kept = need.where(F.col("cost") > K._straight("source", "target")).select(F.col("mid").alias("node")).distinct()
        added = need.groupBy(F.col("mid").alias("node")).agg(F.count(F.lit(1)).alias("added"))
        free = a.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("arcs")).join(kept, "node", "left_anti").join(added, "node", "left")
        rank = F.struct((F.coalesce("added", F.lit(0)) - F.col("arcs")).alias("w"), F.xxhash64("node", F.lit(level)).alias("h"), "node")
        free = search.scratch(free.select("node", rank.alias("r")))
        if free.isEmpty():
            discard(need, free)
            break
        near = a.select("source", F.col("target").alias("node")).join(free, "node").groupBy("source").agg(F.min("r").alias("near"))
        out = free.join(near.withColumnRenamed("source", "node"), "node", "left").where("near is null or r < near").select("node", "r")
        out, short, rest = _removed(a, search.scratch(out))
        mark = out.withColumn("level", F.lit(level))
        gone = mark if gone is None else gone.unionByName(mark)
        best = rest.unionByName(short).groupBy("source", "target").agg(F.min(F.struct("cost", F.coalesce("mid", F.lit(-1)).alias("m"))).alias("b"))
        a = search.scratch(best.select("source", "target", F.col("b.cost").alias("cost"), F.when(F.col("b.m") >= 0, F.col("b.m")).alias("mid")))
        every = every.unionByName(a.where("mid is not null"))
        discard(need)
        level += 1
    nodes = arcs.select(F.col("source").alias("node")).unionByName(arcs.select(F.col("target").alias("node"))).distinct()
    gone = nodes.where(F.lit(False)).withColumn("level", F.lit(0)) if gone is None else gone
    top = nodes.join(gone, "node", "left_anti").withColumn("level", F.lit(level))
    best = every.groupBy("source", "target").agg(F.min(F.struct("cost", F.coalesce("mid", F.lit(-1)).alias("m"))).alias("b"))
    best = best.select("source", "target", F.col("b.cost").alias("cost"), F.when(F.col("b.m") >= 0, F.col("b.m")).alias("mid"))
    return search.scratch(gone.unionByName(top)), search.scratch(best)


def level_sizes(levels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(level, nodes, up): nodes of each level and arcs from them to no lower level."""
    own, to = levels.select(F.col("node").alias("source"), "level"), levels.select(F.col("node").alias("target"), F.col("level").alias("other"))
    up = arcs.join(own, "source").join(to, "target").where("level <= other").groupBy("level").agg(F.count(F.lit(1)).alias("up"))
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("nodes")).join(up, "level", "left").select("level", "nodes", F.coalesce("up", F.lit(0)).alias("up"))


def level_costs(problems: DataFrame, subgoals: DataFrame, arcs: DataFrame, most: int | None = None) -> DataFrame:
    """(id, cost) of problems (id, source, target) by subgoals in levels: both ends are joined to the subgoals that they
    reach directly, and to each other if they do, and from there paths only climb to where they meet. Without a path
    there is no row."""
    arcs = search.scratch(arcs.select("source", "target", "cost"))
    levels, graph = r_contracted(K.subgoal_graph(subgoals, arcs), most)
    ends = problems.where("source <> target").select("source", "target").distinct()
    goals = subgoals.select(F.col("source").alias("node")).distinct()
    start = search.scratch(K.freespace(arcs, ends))
    back = K.freespace(arcs, ends.select(F.col("target").alias("source")))
    out = start.join(goals, "node", "left_semi").select(start_of(F.col("source")).alias("source"), F.col("node").alias("target"), "cost")
    into = back.join(goals, "node", "left_semi").select(F.col("node").alias("source"), goal_of(F.col("source")).alias("target"), "cost")
    direct = start.withColumnRenamed("node", "target").join(ends, ["source", "target"], "left_semi").select(start_of(F.col("source")).alias("source"), goal_of(F.col("target")).alias("target"), "cost")
    low = ends.select(start_of(F.col("source")).alias("node")).unionByName(ends.select(goal_of(F.col("target")).alias("node"))).distinct().withColumn("level", F.lit(-1))
    alone = goals.join(levels, "node", "left_anti").withColumn("level", F.lit(0))  # subgoals that reach no other
    every = search.scratch(graph.select("source", "target", "cost").unionByName(out).unionByName(into).unionByName(direct))
    asked = problems.where("source <> target").select("id", start_of(F.col("source")).alias("source"), goal_of(F.col("target")).alias("target"))
    found = hierarchy_costs(asked, search.scratch(levels.unionByName(alone).unionByName(low)), every)
    return found.unionByName(problems.where("source = target").select("id", F.lit(0).cast("long").alias("cost")))
