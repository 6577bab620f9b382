"""Searches over reduced graphs: clusters with borders, rectangles with perimeters, subgoals, and moves that are followed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import octile
from ..plans import search
from ..plans.scratch import discard
from . import grid as G, visibility as V
from .paths import WIDTH, _octile, node, numbered, solved


def _straight(a: str, b: str):
    """Octile distance of the nodes in two columns."""
    return octile(F.col(a) % WIDTH, F.expr(f"{a} div {WIDTH}"), F.col(b) % WIDTH, F.expr(f"{b} div {WIDTH}"))


def freespace(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost) of the nodes that a source reaches at their octile distance. Each node on the way is reached so
    as well, so a search goes no further than what it returns, whatever the size of the map."""
    arcs = search.scratch(arcs.select("source", "target", "cost"))
    if search.few(arcs):

        def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for s in batch["source"].tolist():
                h, done, todo = _octile(s), {s: 0}, [s]
                while todo:
                    n = todo.pop()
                    for t, c in graph.out.get(n, ()):
                        if t not in done and done[n] + c == h(t):
                            done[t] = done[n] + c
                            todo.append(t)
                rows += [(s, n, c) for n, c in done.items()]
            return pd.DataFrame(rows, columns=["source", "node", "cost"])

        return search.mapped(sources.select("source").distinct(), arcs, "source long, node long, cost long", kernel)
    best = search.scratch(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost")))
    frontier, steps = best, arcs.select(F.col("source").alias("node"), "target", F.col("cost").alias("step"))
    while not frontier.isEmpty():
        ahead = frontier.join(steps, "node").select("source", F.col("target").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))
        ahead = ahead.where(F.col("cost") == _straight("source", "node")).distinct()
        frontier = search.scratch(ahead.join(best.select("source", "node"), ["source", "node"], "left_anti"))
        best = search.scratch(best.unionByName(frontier))
    return best


def h_reachable(problems: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, reachable): whether a path as long as the octile distance joins the ends of problems (id, source, target)."""
    free = freespace(arcs, problems).select("source", F.col("node").alias("target"), F.lit(True).alias("reachable"))
    return problems.join(free, ["source", "target"], "left").select("id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def subgoal_graph(subgoals: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, target, cost): subgoals (source) that reach each other at their octile distance."""
    to = subgoals.select(F.col("source").alias("target"))
    return freespace(arcs, subgoals).withColumnRenamed("node", "target").where("source <> target").join(to, "target", "left_semi").select("source", "target", "cost")


def subgoal_costs(problems: DataFrame, subgoals: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, cost, path) of problems (id, source, target) over undirected arcs: both ends are connected to the subgoals that
    they reach directly, and the graph of subgoals is searched. The path is one of ends and subgoals; refine it by unit
    moves along each leg."""
    arcs = search.scratch(arcs)
    goals = subgoals.select(F.col("source").alias("node"))
    start = search.scratch(freespace(arcs, problems))
    out = start.join(goals, "node", "left_semi").select("source", F.col("node").alias("target"), "cost")
    into = freespace(arcs, problems.select(F.col("target").alias("source"))).join(goals, "node", "left_semi").select(F.col("node").alias("source"), F.col("source").alias("target"), "cost")
    direct = start.withColumnRenamed("node", "target").join(problems.select("source", "target").distinct(), ["source", "target"], "left_semi").select("source", "target", "cost")
    every = subgoal_graph(subgoals, arcs).unionByName(out).unionByName(into).unionByName(direct).where("source <> target").distinct()
    found = solved(problems.where("source <> target"), every, "dijkstra").select("id", "cost", "path")
    same = problems.where("source = target").select("id", F.lit(0).cast("long").alias("cost"), F.array("source").alias("path"))
    return found.unionByName(same)


def cluster_costs(problems: DataFrame, cells: DataFrame, size: int = 10) -> DataFrame:
    """(id, cost) of problems (id, source, target): maps are cut into clusters of size * size cells, distances between the
    border cells of each are found within it, by tasks that see one cluster, and the graph of border cells is searched,
    with both ends put in. As all border cells are kept, costs are the shortest."""
    arcs = search.scratch(numbered(cells))
    at = lambda n: (F.expr(f"({n} % {WIDTH}) div {size}"), F.expr(f"({n} div {WIDTH}) div {size}"))
    marked = arcs.withColumns({"cx": at("source")[0], "cy": at("source")[1]}).withColumn("inner", (F.col("cx") == at("target")[0]) & (F.col("cy") == at("target")[1]))
    ends = [problems.select(F.col(c).alias("a"), F.lit(None).cast("long").alias("b"), F.lit(k).alias("kind")) for c, k in (("source", "s"), ("target", "g"))]
    same = problems.where((at("source")[0] == at("target")[0]) & (at("source")[1] == at("target")[1])).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("d").alias("kind"))
    points = ends[0].unionByName(ends[1]).unionByName(same).distinct().withColumns({"cx": at("a")[0], "cy": at("a")[1]})

    def within(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(inner=own["inner"].astype(bool))
        inner = own[own["inner"]]
        there = search.Graph(inner["source"].tolist(), inner["target"].tolist(), inner["cost"].tolist())
        back = search.Graph(inner["target"].tolist(), inner["source"].tolist(), inner["cost"].tolist())
        border, rows, known = set(own[~own["inner"]]["source"].tolist()), [], {}
        for n in border:
            rows += [(n, t, c) for t, c in there.distances(n).items() if t in border and t != n]
        for a, b, kind in asked[["a", "b", "kind"]].itertuples(index=False, name=None):
            if kind == "g":
                rows += [(t, a, c) for t, c in back.distances(a).items() if t in border and t != a]
            else:
                d = known.setdefault(a, None) or there.distances(a)
                known[a] = d
                rows += [(a, t, d[t]) for t in (border if kind == "s" else {int(b)}) if t in d and t != a]
        return pd.DataFrame(rows, columns=["source", "target", "cost"])

    inside = marked.groupBy("cx", "cy").cogroup(points.groupBy("cx", "cy")).applyInPandas(within, "source long, target long, cost long")
    graph = inside.unionByName(marked.where("not inner").select("source", "target", "cost")).distinct()
    found = solved(problems.where("source <> target"), graph, "dijkstra").select("id", "cost")
    return found.unionByName(problems.where("source = target").select("id", F.lit(0).cast("long").alias("cost")))


def perimeters(boxes: DataFrame) -> DataFrame:
    """(pid, x, y): the cells along the sides of boxes (x1, y1, x2, y2)."""
    side = lambda a, b, f: F.transform(F.sequence(F.col(a), F.col(b) - 1), f)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    around = F.concat(
        side("x1", "x2", lambda v: at(v, F.col("y1"))), side("x1", "x2", lambda v: at(v, F.col("y2") - 1)), side("y1", "y2", lambda v: at(F.col("x1"), v)), side("y1", "y2", lambda v: at(F.col("x2") - 1, v))
    )
    return boxes.select(F.struct("x1", "y1").alias("pid"), F.explode(F.array_distinct(around)).alias("p")).select("pid", "p.x", "p.y")


def rectangle_graph(cells: DataFrame) -> DataFrame:
    """(source, target, cost): cells on the perimeters of empty rectangles, joined across each rectangle by its octile
    distances and to the next rectangles by moves that may cut corners. Costs between perimeters stay the shortest, and no
    cell inside a rectangle is in the graph."""
    edge = search.scratch(perimeters(V.rectangles(cells)).select("pid", node("x", "y").alias("n")))
    a, b = edge.select("pid", F.col("n").alias("source")), edge.select("pid", F.col("n").alias("target"))
    across = a.join(b, "pid").where("source <> target").select("source", "target", _straight("source", "target").cast("long").alias("cost"))
    owner = lambda c, p: edge.select(F.col("n").alias(c), F.col("pid").alias(p))
    moves = numbered(cells, cut_corners=True).join(owner("source", "p"), "source").join(owner("target", "q"), "target").where("p <> q").select("source", "target", "cost")
    return across.unionByName(moves)


#: Ranks of a bin, by which runs of a first-move table meet the targets that are asked for.
RUN_BIN = 16


def looked_up(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, target, move) of a first-move table (source, run_begin, move), in which a row holds from its target on to the
    next row's, for each of `targets` (target). Runs become ranges of whole ranks, and these and the targets meet by bins."""
    after = F.lead("run_begin").over(Window.partitionBy("source").orderBy("run_begin"))
    ends = search.scratch(runs.select("source", "move", F.col("run_begin").alias("begin"), after.alias("end")))
    known = ends.select(F.col("begin").alias("node")).unionByName(targets.select(F.col("target").alias("node"))).distinct()
    ranks = search.scratch(G.ranked(known))
    rank = lambda name, to: ranks.select(F.col("node").alias(name), F.col("rank").alias(to))
    last = ranks.agg(F.coalesce(F.max("rank"), F.lit(-1))).first()[0]
    ranges = ends.join(rank("begin", "from"), "begin").join(rank("end", "to"), "end", "left").withColumn("to", F.coalesce(F.col("to") - 1, F.lit(last)))
    ranges = ranges.withColumn("bin", F.explode(F.sequence(F.expr(f"from div {RUN_BIN}"), F.expr(f"to div {RUN_BIN}"))))
    asked = targets.distinct().join(rank("target", "r"), "target").withColumn("bin", F.expr(f"r div {RUN_BIN}"))
    return ranges.join(asked, "bin").where("r between from and to").select(F.col("source").alias("node"), "target", "move")


def followed(problems: DataFrame, runs: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, cost, steps) of problems (id, source, target) by a first-move table as run lengths (source, run_begin, move), over
    undirected arcs. No path is searched: the moves towards all targets asked for are looked up, and the table of them is
    composed with itself, so that each round doubles the steps that a row stands for; rounds are as many as the binary
    digits of the longest path. Problems without a path give no row."""
    arcs = search.scratch(arcs.select("source", "target", "cost"))
    asked = search.scratch(problems.select("source", "target").distinct())
    targets = asked.select("target").distinct()
    nodes = arcs.select(F.col("source").alias("node")).unionByName(asked.select(F.col("target").alias("node"))).distinct()
    parts = search.scratch(search.components(arcs, nodes))
    moves = looked_up(runs, targets).where("node <> target").join(arcs.select(F.col("source").alias("node"), F.col("target").alias("move"), "cost"), ["node", "move"])
    # a run also spans targets that its node does not reach
    moves = moves.join(parts.withColumnRenamed("component", "part"), "node").join(parts.select(F.col("node").alias("target"), F.col("component").alias("other")), "target").where("part = other")
    names = ["node", "target", "move", "cost", "steps"]
    table = search.scratch(moves.withColumn("steps", F.lit(1).cast("long")).select(names))
    while True:
        way = table.where("move <> target")
        if way.join(asked.withColumnRenamed("source", "node"), ["node", "target"], "left_semi").isEmpty():
            break
        ahead = table.select(F.col("node").alias("move"), "target", F.col("move").alias("then"), F.col("cost").alias("more"), F.col("steps").alias("rest"))
        far = way.join(ahead, ["move", "target"]).select("node", "target", F.col("then").alias("move"), (F.col("cost") + F.col("more")).alias("cost"), (F.col("steps") + F.col("rest")).alias("steps"))
        before, table = table, search.scratch(table.where("move = target").unionByName(far))
        discard(before)
    found = table.where("move = target").select(F.col("node").alias("source"), "target", "cost", "steps")
    same = asked.where("source = target").select("source", "target", F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("steps"))
    return problems.join(found.unionByName(same), ["source", "target"]).select("id", "cost", "steps")


def generated(cells: DataFrame, arcs: DataFrame, count: int) -> DataFrame:
    """(id, source, target, cost): of `count` pairs of open cells, drawn by their rank times large primes, those that a path
    joins. Reruns agree."""
    ranks = search.scratch(G.ranked(cells.select(node("x", "y").alias("node"))))
    n = ranks.count()
    draw = cells.sparkSession.range(count).select("id", (F.col("id") * 7919 % n).alias("a"), ((F.col("id") * 104_729 + 13) % n).alias("b"))
    pairs = draw.join(ranks.select(F.col("rank").alias("a"), F.col("node").alias("source")), "a").join(ranks.select(F.col("rank").alias("b"), F.col("node").alias("target")), "b")
    return solved(pairs.where("source <> target"), arcs).where("cost is not null").select("id", "source", "target", "cost")
