"""Graphs beyond searches: unpacking, reduction, connection, orders, relaxed searches, lattices."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans import search
from . import grid as G
from .paths import WIDTH, _octile


#: Motion primitives that may be sent to every task.
MOST_PRIMITIVES = 10_000


def unpacked(arcs: DataFrame) -> DataFrame:
    """(source, target, n_arcs, cost): each arc of a hierarchy taken apart at its middle nodes until none is left; the
    cost is summed again over the original arcs."""
    known = search.scratch(arcs.select("source", "target", "cost", "mid"))
    out, todo = None, known.select(F.col("source").alias("s"), F.col("target").alias("t"), "source", "target")
    while True:
        j = search.scratch(todo.join(known, ["source", "target"]))
        done = j.where("mid is null").select("s", "t", "cost")
        out = done if out is None else out.unionByName(done)
        rest = j.where("mid is not null")
        if rest.isEmpty():
            return out.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count(F.lit(1)).alias("n_arcs"), F.sum("cost").alias("cost"))
        half = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("mid").alias("b")), F.struct(F.col("mid").alias("a"), F.col("target").alias("b"))))
        todo = rest.select("s", "t", half.alias("h")).select("s", "t", F.col("h.a").alias("source"), F.col("h.b").alias("target"))


def irredundant(arcs: DataFrame) -> DataFrame:
    """Arcs that no two others of the same total cost replace."""
    a, b = arcs.select("source", F.col("target").alias("via"), F.col("cost").alias("c1")), arcs.select(F.col("source").alias("via"), "target", F.col("cost").alias("c2"))
    two = a.join(b, "via").groupBy("source", "target").agg(F.min(F.col("c1") + F.col("c2")).alias("c"))
    return arcs.join(two, ["source", "target"], "left").where("c is null or c > cost").select("source", "target", "cost")


def relaxed_costs(problems: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, cost) by a search that never improves a node it has reached; costs may exceed the shortest."""

    def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s, t in zip(batch["source"].tolist(), batch["target"].tolist()):
            h, cost, heap = _octile(t), {s: 0}, [(0, s)]
            while heap and t not in cost:
                _, n = heapq.heappop(heap)
                for m, c in graph.out.get(n, ()):
                    if m not in cost:
                        cost[m] = cost[n] + c
                        heapq.heappush(heap, (cost[m] + h(m), m))
            rows.append((s, t, cost.get(t)))
        return pd.DataFrame(rows, columns=["source", "target", "cost"]).astype({"cost": "Int64"})

    got = search.mapped(problems.select("source", "target").distinct(), arcs, "source long, target long, cost long", kernel)
    return problems.join(got, ["source", "target"]).select("id", "cost")


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component): the smallest node of those that reach each other. A graph too large for one task is done in
    rounds over tables."""
    arcs = search.scratch(arcs.select("source", "target").distinct())
    if not search.few(arcs):
        return _strong_by_rounds(arcs)
    s, t, _ = search.collected(arcs.select("source", "target", F.lit(0).alias("cost")))
    out: dict[int, list[int]] = {}
    for a, b in zip(s, t):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    back: dict[int, list[int]] = {n: [] for n in out}
    for a, b in zip(s, t):
        back[b].append(a)
    order, seen = [], set()
    for start in sorted(out):  # by the time of completion, then backwards
        stack = [(start, iter(out[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            nxt = next((m for m in stack[-1][1] if m not in seen), None)
            if nxt is None:
                order.append(stack.pop()[0])
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out[nxt])))
    label: dict[int, int] = {}
    for start in reversed(order):
        group, todo = [], [start]
        while todo:
            n = todo.pop()
            if n not in label:
                label[n] = start
                group.append(n)
                todo += back[n]
        for n in group:
            label[n] = min(group)
    return arcs.sparkSession.createDataFrame(pd.DataFrame({"node": list(label), "component": list(label.values())}, dtype="int64"), "node long, component long")


def _reached(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, label) from labels (node, label): the least label that leads to a node over the arcs, where one does."""
    best = frontier = search.scratch(labels)
    while True:
        offers = frontier.join(arcs.withColumnRenamed("source", "node"), "node").groupBy("target").agg(F.min("label").alias("offer"))
        better = offers.join(best.withColumnRenamed("node", "target"), "target", "left").where("label is null or offer < label")
        frontier = search.scratch(better.select(F.col("target").alias("node"), F.col("offer").alias("label")))
        if frontier.isEmpty():
            return best
        best = search.scratch(best.unionByName(frontier).groupBy("node").agg(F.min("label").alias("label")))


def _strong_by_rounds(arcs: DataFrame) -> DataFrame:
    """Nodes without in- or out-arcs are components of their own and go. Of the others each takes the least node that leads
    to it; those of that colour that lead back to its node are a component, and what is left is coloured again."""
    done, left = None, arcs.where("source <> target")
    every = arcs.select(F.col("source").alias("node")).unionByName(arcs.select(F.col("target").alias("node"))).distinct()
    while not left.isEmpty():
        ends = left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        left = search.scratch(left.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi"))
        nodes = left.select(F.col("source").alias("node")).unionByName(left.select(F.col("target").alias("node"))).distinct()
        colour = _reached(nodes.select("node", F.col("node").alias("label")), left)
        own = left.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target").where("a = b")
        back = own.select(F.col("target").alias("source"), F.col("source").alias("target"))
        found = _reached(colour.where("node = label"), search.scratch(back)).select("node", F.col("label").alias("component"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = search.scratch(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti"))
    if done is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def lattice_arcs(cells: DataFrame, primitives: DataFrame) -> DataFrame:
    """(x, y, o, x2, y2, o2, cost) over primitives (o, o2, dx, dy, cost, swept array<struct<dx,dy>>): moves none of
    whose swept cells is blocked. One aggregate counts the open ones of each move."""
    if primitives.limit(MOST_PRIMITIVES + 1).count() > MOST_PRIMITIVES:
        raise ValueError(f"more than {MOST_PRIMITIVES} primitives")
    nodes = cells.crossJoin(F.broadcast(primitives.withColumn("pid", F.xxhash64("o", "o2", "dx", "dy"))))
    swept = nodes.select("x", "y", "pid", F.explode("swept").alias("s")).select("x", "y", "pid", (F.col("x") + F.col("s.dx")).alias("sx"), (F.col("y") + F.col("s.dy")).alias("sy"))
    blocked = swept.join(cells.select(F.col("x").alias("sx"), F.col("y").alias("sy")), ["sx", "sy"], "left_anti").select("x", "y", "pid").distinct()
    out = nodes.join(blocked, ["x", "y", "pid"], "left_anti")
    return out.select("x", "y", "o", (F.col("x") + F.col("dx")).alias("x2"), (F.col("y") + F.col("dy")).alias("y2"), "o2", "cost")


def connected_to(points: DataFrame, subgoals: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, subgoal, cost): subgoals that a point reaches at its octile distance, found without going further."""
    from .hierarchies import freespace

    return freespace(arcs, points).join(subgoals.select(F.col("source").alias("node")), "node", "left_semi").select("source", F.col("node").alias("subgoal"), "cost")


def unit_arcs(cells: DataFrame) -> DataFrame:
    a = G.arcs(cells)
    return a.select((F.col("y") * WIDTH + F.col("x")).alias("source"), (F.col("y2") * WIDTH + F.col("x2")).alias("target"), F.lit(1).cast("long").alias("cost"))
