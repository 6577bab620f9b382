"""Shortest paths two ways: set-oriented rounds over tables of any size, and searches in tasks over a broadcast graph.

Arcs are (source, target, cost) with whole-number costs. `choose` counts them first: up to BROADCAST_ARCS they are sent
to every task, where many searches run side by side; beyond that each round is a join of the frontier with the arcs.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .scratch import stored

#: Arcs that may be sent to every task; 24 bytes each.
BROADCAST_ARCS = 2_000_000
MAX_ROUNDS = 100_000


def scratch(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, which a lost executor does not take along."""
    return stored(df, "paths")


def few(arcs: DataFrame, limit: int | None = None) -> bool:
    """Whether the arcs may be sent to every task."""
    most = BROADCAST_ARCS if limit is None else limit
    return arcs.limit(most + 1).count() <= most


class Graph:
    """Adjacency lists; built once per Python worker from three arrays."""

    def __init__(self, source: list[int], target: list[int], cost: list[int]) -> None:
        self.out: dict[int, list[tuple[int, int]]] = {}
        for s, t, c in zip(source, target, cost):
            self.out.setdefault(s, []).append((t, c))
        for v in self.out.values():
            v.sort()

    def distances(self, source: int, bound: int | None = None) -> dict[int, int]:
        """Costs from source, to all or as far as bound."""
        done: dict[int, int] = {}
        heap = [(0, source)]
        while heap:
            d, n = heapq.heappop(heap)
            if n in done or (bound is not None and d > bound):
                continue
            done[n] = d
            for t, c in self.out.get(n, ()):
                if t not in done:
                    heapq.heappush(heap, (d + c, t))
        return done

    def search(self, source: int, target: int, h: Callable[[int], int] = lambda n: 0) -> tuple[int | None, list[int], int]:
        """Cost, path and number of nodes expanded; ties go to the larger cost so far, then to the smaller node."""
        best, parent, closed = {source: 0}, {source: source}, set()
        heap = [(h(source), 0, source)]
        while heap:
            _, g, n = heapq.heappop(heap)
            if n in closed:
                continue
            if n == target:
                path = [n]
                while parent[n] != n:
                    n = parent[n]
                    path.append(n)
                return best[target], path[::-1], len(closed)
            closed.add(n)
            for t, c in self.out.get(n, ()):
                if t not in closed and (t not in best or best[n] + c < best[t]):
                    best[t], parent[t] = best[n] + c, n
                    heapq.heappush(heap, (best[t] + h(t), -best[t], t))
        return None, [], len(closed)

    def bidirectional(self, other: "Graph", source: int, target: int) -> int | None:
        """Cost by two searches that meet; `other` has the arcs reversed."""
        if source == target:
            return 0
        sides = [({source: 0}, [(0, source)], self, set()), ({target: 0}, [(0, target)], other, set())]
        best = None
        while sides[0][1] and sides[1][1]:
            if best is not None and sides[0][1][0][0] + sides[1][1][0][0] >= best:
                break
            k = 0 if sides[0][1][0][0] <= sides[1][1][0][0] else 1
            dist, heap, graph, done = sides[k]
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            for t, c in graph.out.get(n, ()):
                if d + c < dist.get(t, d + c + 1):
                    dist[t] = d + c
                    heapq.heappush(heap, (d + c, t))
                if t in sides[1 - k][0] and (best is None or dist[t] + sides[1 - k][0][t] < best):
                    best = dist[t] + sides[1 - k][0][t]
        return best


def collected(arcs: DataFrame, limit: int | None = None) -> tuple[list[int], list[int], list[int]]:
    """The arcs as three lists, in order; refused beyond `limit`."""
    limit = BROADCAST_ARCS if limit is None else limit
    rows = arcs.select("source", "target", "cost").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} arcs: use the rounds over tables")
    rows = rows.sort_values(["source", "target", "cost"])
    return rows["source"].tolist(), rows["target"].tolist(), rows["cost"].tolist()


def mapped(rows: DataFrame, arcs: DataFrame, schema: str, kernel: Callable[[Graph, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Runs kernel(graph, batch of rows) in tasks; the graph is broadcast and built once per batch stream."""
    lists = rows.sparkSession.sparkContext.broadcast(collected(arcs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for batch in batches:
            graph = graph or Graph(*lists.value)
            yield kernel(graph, batch)

    return rows.mapInPandas(run, schema)


def rounds(arcs: DataFrame, seeds: DataFrame, node: str = "node") -> DataFrame:
    """(node, cost) from (node, cost) seeds, by rounds: only nodes whose cost fell in the last round send it on."""
    best = scratch(seeds.groupBy(node).agg(F.min("cost").alias("cost")))
    frontier, a = best, scratch(arcs.select(F.col("source").alias(node), "target", F.col("cost").alias("step")))
    for _ in range(MAX_ROUNDS):
        offers = frontier.join(a, node).groupBy("target").agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        better = offers.join(best.withColumnRenamed(node, "target"), "target", "left").where("cost is null or offer < cost")
        frontier = scratch(better.select(F.col("target").alias(node), F.col("offer").alias("cost")))
        if frontier.isEmpty():
            return best
        best = scratch(best.unionByName(frontier).groupBy(node).agg(F.min("cost").alias("cost")))
    raise RuntimeError("no fixpoint")


def single_source(arcs: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, node, cost) for each of `sources` (source) and each node that it reaches."""
    arcs = scratch(arcs.select("source", "target", "cost"))  # counted and then read: worth writing once
    if few(arcs, limit):

        def kernel(graph: Graph, batch: pd.DataFrame) -> pd.DataFrame:
            parts = [(s, graph.distances(s)) for s in batch["source"].tolist()]
            return pd.DataFrame({"source": [s for s, d in parts for _ in d], "node": [n for _, d in parts for n in d], "cost": [c for _, d in parts for c in d.values()]}, dtype="int64")

        return mapped(sources, arcs, "source long, node long, cost long", kernel)
    # node and source together make one key; arcs are joined on the node alone
    seeds = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"))
    best, frontier, a = scratch(seeds), seeds, scratch(arcs.select(F.col("source").alias("node"), "target", F.col("cost").alias("step")))
    while True:
        offers = frontier.join(a, "node").groupBy("source", "target").agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        better = offers.join(best.withColumnRenamed("node", "target"), ["source", "target"], "left").where("cost is null or offer < cost")
        frontier = scratch(better.select("source", F.col("target").alias("node"), F.col("offer").alias("cost")))
        if frontier.isEmpty():
            return best
        best = scratch(best.unionByName(frontier).groupBy("source", "node").agg(F.min("cost").alias("cost")))


def components(arcs: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over arcs taken both ways. Up to `limit` arcs, which are then few
    enough to be broadcast for searches, are united on the driver; beyond that each round maps nodes to that of
    themselves and their neighbours whose hash is least and contracts the arcs by that map: only local minima of a
    random order stay, so the rounds are logarithmic."""
    if few(arcs, limit):
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while root.setdefault(n, n) != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for s, t, _ in zip(*collected(arcs.select("source", "target", F.lit(0).alias("cost")), limit)):
            a, b = find(s), find(t)
            root[max(a, b)] = min(a, b)
        labels = arcs.sparkSession.createDataFrame(pd.DataFrame({"node": list(root), "component": [find(n) for n in root]}, dtype="int64"), "node long, component long")
        return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    maps, e = [], scratch(arcs.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u < v").distinct())
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        to = scratch(best.select("u", F.when(F.col("m.h") < F.xxhash64("u"), F.col("m.v")).otherwise(F.col("u")).alias("to")))
        maps.append(to)
        e = e.join(to.withColumnRenamed("to", "a"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        e = scratch(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    out = nodes.select("node", F.col("node").alias("root"))
    for m in maps:
        out = out.join(m.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = scratch(out)
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def walked(problems: DataFrame, distances: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, target, path) of problems (source, target) by joins: from the target back over the smallest node whose
    distance and arc make up the distance, one round for each step of the longest path."""
    into = arcs.select(F.col("target").alias("node"), F.col("source").alias("before"), F.col("cost").alias("step"))
    far = lambda n, c: distances.select("source", F.col("node").alias(n), F.col("cost").alias(c))
    at = stored(problems.select("source", "target").distinct().join(far("target", "cost"), ["source", "target"]).select("source", "target", F.col("target").alias("node"), "cost", F.lit(0).alias("k")))
    parts = [at]
    while True:
        rest = at.where("node <> source")
        if rest.isEmpty():
            break
        ahead = rest.join(into, "node").join(far("before", "left"), ["source", "before"]).where("left + step = cost")
        at = ahead.groupBy("source", "target", "k").agg(F.min(F.struct("before", "left")).alias("b")).select("source", "target", F.col("b.before").alias("node"), F.col("b.left").alias("cost"), (F.col("k") + 1).alias("k"))
        at = stored(at)
        parts.append(at)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    steps = F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "node")))
    return every.groupBy("source", "target").agg(steps.alias("s")).select("source", "target", F.transform("s", lambda v: v["node"]).alias("path"))
