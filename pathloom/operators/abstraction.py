"""Abstract graphs of grid maps: clusters joined by entrances, in levels, searched with both ends put in and refined."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans import search
from . import grid as G
from .paths import WIDTH, node, numbered, solved


def start_of(n: Column) -> Column:
    """The number under which a cell is put into a graph as a start: arcs only leave it, so no path leads through it."""
    return -(2 * n + 1)


def goal_of(n: Column) -> Column:
    """The number under which a cell is put into a graph as a goal: arcs only enter it."""
    return -(2 * n + 2)


def _cell(c: str) -> str:
    return f"(case when {c} < 0 then (-{c} - 1) div 2 else {c} end)"


def crossings(cells: DataFrame, size: int = 10, wide: int = 6) -> DataFrame:
    """(source, target, cost), both ways: the moves by which clusters of size * size cells are left. A run of open pairs along
    a border has one in its middle, or one at each end if it is `wide` or longer; clusters that touch in a corner are joined
    there by a legal diagonal move, if there is one."""
    upright = G.entrances(cells, size, wide).select(node("border", "at").alias("source"), (node("border", "at") + 1).alias("target"), F.lit(G.STRAIGHT).cast("long").alias("cost"))
    flat = G.entrances(cells.select(F.col("y").alias("x"), F.col("x").alias("y")), size, wide)
    flat = flat.select(node("at", "border").alias("source"), (node("at", "border") + WIDTH).alias("target"), F.lit(G.STRAIGHT).cast("long").alias("cost"))
    both = upright.unionByName(flat)
    both = both.unionByName(both.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost"))
    corner = G.arcs(cells).where(f"x div {size} <> x2 div {size} and y div {size} <> y2 div {size}")
    return both.unionByName(corner.select(node("x", "y").alias("source"), node("x2", "y2").alias("target"), "cost"))


def _tree(graph: search.Graph, source: int) -> tuple[dict[int, int], dict[int, int]]:
    """Costs from source and the node before each; of equal ways the first one found by cost and number stays."""
    cost, before, done, heap = {source: 0}, {}, set(), [(0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        for t, c in graph.out.get(n, ()):
            if d + c < cost.get(t, d + c + 1):
                cost[t], before[t] = d + c, n
                heapq.heappush(heap, (d + c, t))
    return cost, before


def _within(arcs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Paths inside one cluster: from its borders and starts to its borders and goals, and of the pairs that are asked for."""
    graph = search.Graph(arcs["source"].tolist(), arcs["target"].tolist(), arcs["cost"].tolist())
    nodes, pairs = asked.loc[asked["goal"].isna(), "node"].tolist(), {}
    for n, t in asked.loc[asked["goal"].notna(), ["node", "goal"]].itertuples(index=False, name=None):
        pairs.setdefault(n, set()).add(int(t))
    borders, goals = {n for n in nodes if n >= 0}, {n for n in nodes if n < 0 and n % 2 == 0}
    rows = []
    for n in (n for n in nodes if n >= 0 or n % 2):
        cost, before = _tree(graph, n)
        for t in sorted(borders | (goals if n >= 0 else pairs.get(n, set()))):
            if t == n or t not in cost:
                continue
            path = [t]
            while path[-1] != n:
                path.append(before[path[-1]])
            rows.append((n, t, cost[t], path[::-1]))
    return pd.DataFrame(rows, columns=["source", "target", "cost", "path"])


def abstracted(edges: DataFrame, crossing: DataFrame, points: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(source, target, cost, path): the graph above `edges` over clusters of size * size cells. Its nodes are the ends of
    `crossing` and `points` (node); paths within a cluster are found by a task that sees that cluster alone, and are kept
    with their edge, so that it can be refined by a join. pairs (node, goal) are joined directly where a cluster holds both."""
    at = lambda c: [F.expr(f"{_cell(c)} % {WIDTH} div {size}").alias("cx"), F.expr(f"{_cell(c)} div {WIDTH} div {size}").alias("cy")]
    own, to = at("source"), at("target")
    inner = edges.where((own[0] == to[0]) & (own[1] == to[1])).select("source", "target", "cost", *own)
    none = F.lit(None).cast("long").alias("goal")
    nodes = crossing.select(F.col("source").alias("node")).unionByName(crossing.select(F.col("target").alias("node"))).unionByName(points.select("node")).distinct().select("node", none)
    near = pairs.where((at("node")[0] == at("goal")[0]) & (at("node")[1] == at("goal")[1])).select("node", "goal").distinct()
    asked = nodes.unionByName(near).select("node", "goal", *at("node"))
    inside = inner.groupBy("cx", "cy").cogroup(asked.groupBy("cx", "cy")).applyInPandas(_within, "source long, target long, cost long, path array<long>")
    return search.scratch(inside.unionByName(crossing.select("source", "target", "cost", F.array("source", "target").alias("path"))))


def levels(cells: DataFrame, problems: DataFrame, sizes: tuple[int, ...] = (10,), wide: int = 6) -> list[DataFrame]:
    """The abstract graphs (source, target, cost, path) over clusters of each of `sizes`, every one a multiple of the one
    before, with the ends of problems (source, target) put in by `start_of` and `goal_of`. A path lists nodes one level down."""
    ends = problems.select("source", "target").distinct()
    starts, goals = ends.select(F.col("source").alias("n")).distinct(), ends.select(F.col("target").alias("n")).distinct()
    points = search.scratch(starts.select(start_of(F.col("n")).alias("node")).unionByName(goals.select(goal_of(F.col("n")).alias("node"))))
    pairs = search.scratch(ends.select(start_of(F.col("source")).alias("node"), goal_of(F.col("target")).alias("goal")))
    nothing = F.lit(0).cast("long").alias("cost")
    put = starts.select(start_of(F.col("n")).alias("source"), F.col("n").alias("target"), nothing).unionByName(goals.select(F.col("n").alias("source"), goal_of(F.col("n")).alias("target"), nothing))
    edges, out = search.scratch(numbered(cells).unionByName(put)), []
    crossing = search.scratch(crossings(cells, sizes[0], wide))
    for k, size in enumerate(sizes):
        if k:  # edges of the level below that leave its larger clusters
            far = F.expr(f"{_cell('source')} % {WIDTH} div {size} <> {_cell('target')} % {WIDTH} div {size} or {_cell('source')} div {WIDTH} div {size} <> {_cell('target')} div {WIDTH} div {size}")
            crossing = search.scratch(edges.where(far).select("source", "target", "cost"))
        out.append(abstracted(edges, crossing, points, pairs, size))
        edges = out[-1]
    return out


def looked_up(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path) one level down: each leg of paths (id, path) is replaced by the path that its edge (source, target, path)
    keeps."""
    legs = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    rows = paths.select("id", F.posexplode(legs).alias("k", "leg")).select("id", "k", "leg.source", "leg.target")
    found = rows.join(edges.select("source", "target", F.col("path").alias("part")), ["source", "target"])
    parts = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("s"))
    first = F.slice(F.col("s")[0]["part"], 1, 1)
    return parts.select("id", F.concat(first, F.flatten(F.transform("s", lambda p: F.slice(p["part"], 2, F.size(p["part"]))))).alias("path"))


def hierarchical(problems: DataFrame, cells: DataFrame, sizes: tuple[int, ...] = (10,), wide: int = 6) -> DataFrame:
    """(id, source, target, cost, path) of problems (id, source, target) whose ends are open cells: the graph of the highest
    level is searched and its edges are refined down to moves by the paths kept with them. As a border is crossed at its
    entrances only, a path may be longer than the shortest; more levels do not change its cost. Without a path there is no row."""
    problems = search.scratch(problems.select("id", "source", "target"))
    graphs = levels(cells, problems.where("source <> target"), sizes, wide)
    asked = problems.where("source <> target").select(F.struct("source", "target").alias("id"), start_of(F.col("source")).alias("source"), goal_of(F.col("target")).alias("target")).distinct()
    found = search.scratch(solved(asked, graphs[-1].groupBy("source", "target").agg(F.min("cost").alias("cost")), "dijkstra").where("cost is not null").select("id", "cost", "path"))
    paths = found.select("id", "path")
    for edges in reversed(graphs):
        best = edges.groupBy("source", "target").agg(F.min_by("path", F.struct("cost", "path")).alias("path"))
        paths = looked_up(paths, best)
    paths = paths.select("id", F.filter("path", lambda n: n >= 0).alias("path")).join(found.select("id", "cost"), "id").select("id.source", "id.target", "cost", "path")
    same = problems.where("source = target").select("id", "source", "target", F.lit(0).cast("long").alias("cost"), F.array("source").alias("path"))
    return problems.join(paths, ["source", "target"]).select("id", "source", "target", "cost", "path").unionByName(same)
