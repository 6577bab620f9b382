"""Any-angle paths over meshes of convex polygons, and where points lie in them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

EPSILON = 1e-8
BROADCAST_POLYGONS = 500_000


class Mesh:
    """Convex polygons (lists of points, counter-clockwise) with the pairs that share an edge, and the corners at which
    paths may turn. Sight is decided for all corners at once: a segment is cut by each polygon's half-planes, and it is
    seen if polygons that share edges cover it from end to end. Two polygons that only meet at a point do not."""

    def __init__(self, polygons: list[list[tuple[float, float]]], pairs: list[tuple[int, int]], corners: list[tuple[float, float]]) -> None:
        most = max(map(len, polygons))
        p = np.array([v + [v[-1]] * (most - len(v)) for v in polygons], float)
        d = np.roll(p, -1, axis=1) - p
        self.nx, self.ny = -d[:, :, 1], d[:, :, 0]  # inside is where nx * x + ny * y >= c
        self.c = self.nx * p[:, :, 0] + self.ny * p[:, :, 1]
        self.near: list[set[int]] = [set() for _ in polygons]
        for a, b in pairs:
            self.near[a].add(b)
            self.near[b].add(a)
        self.corners = sorted(set(corners))
        self._seen: dict[tuple, list] = {}

    def sees(self, p: tuple[float, float], targets: list[tuple[float, float]]) -> list[bool]:
        if not targets:
            return []
        q = np.array(targets, float)
        at = self.nx * p[0] + self.ny * p[1] - self.c
        step = self.nx[None] * (q[:, 0, None, None] - p[0]) + self.ny[None] * (q[:, 1, None, None] - p[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = -at[None] / step
        low = np.where(step > EPSILON, t, 0.0).max(axis=2)
        high = np.where(step < -EPSILON, t, 1.0).min(axis=2)
        out = ((np.abs(step) <= EPSILON) & (at[None] < -EPSILON)).any(axis=2)
        inside = ~out & (np.maximum(low, 0) <= np.minimum(high, 1) + EPSILON)
        found = []
        for k in range(len(q)):
            own = {i: (max(low[k, i], 0.0), min(high[k, i], 1.0)) for i in np.flatnonzero(inside[k]).tolist()}
            todo = [i for i, (a, _) in own.items() if a <= EPSILON]
            done = set(todo)
            while todo and not any(own[i][1] >= 1 - EPSILON for i in done):
                i = todo.pop()
                for j in self.near[i]:
                    if j in own and j not in done and max(own[i][0], own[j][0]) <= min(own[i][1], own[j][1]) + EPSILON:
                        done.add(j)
                        todo.append(j)
            found.append(any(own[i][1] >= 1 - EPSILON for i in done))
        return found

    def visible(self, p: tuple[float, float]) -> list[tuple[tuple[float, float], float]]:
        if p not in self._seen:
            others = [c for c in self.corners if c != p]
            self._seen[p] = [(c, math.dist(p, c)) for c, s in zip(others, self.sees(p, others)) if s]
        return self._seen[p]

    def shortest(self, p: tuple[float, float], q: tuple[float, float]) -> tuple[float | None, list[tuple[float, float]]]:
        """Length and turning points of a shortest path; None without one."""
        if p == q:
            return (0.0, [p]) if self.sees(p, [q])[0] else (None, [])
        last = {c for c, _ in self.visible(q)}
        best, parent, closed, heap = {p: 0.0}, {p: None}, set(), [(math.dist(p, q), p)]
        while heap:
            _, n = heapq.heappop(heap)
            if n in closed:
                continue
            closed.add(n)
            if n == q:
                path = []
                while n is not None:
                    path.append(n)
                    n = parent[n]
                return best[q], path[::-1]
            ways = list(self.visible(n))
            if n in last or (n == p and self.sees(p, [q])[0]):
                ways.append((q, math.dist(n, q)))
            for t, w in ways:
                if t not in closed and best[n] + w < best.get(t, math.inf) - 1e-12:
                    best[t], parent[t] = best[n] + w, n
                    heapq.heappush(heap, (best[t] + math.dist(t, q), t))
        return None, []


def mesh_paths(polygons: DataFrame, pairs: DataFrame, corners: DataFrame, problems: DataFrame) -> DataFrame:
    """(id, length, points) of problems (id, sx, sy, gx, gy) over polygons (pid, points), pairs (a, b) of pids that
    share an edge, and corners (x, y). Tasks hold the mesh, whose size is checked; equal problems are solved once."""
    rows = polygons.select("pid", "points").limit(BROADCAST_POLYGONS + 1).collect()
    if len(rows) > BROADCAST_POLYGONS:
        raise ValueError(f"more than {BROADCAST_POLYGONS} polygons")
    rows = sorted(rows, key=lambda r: r["pid"])
    limit = 20 * BROADCAST_POLYGONS
    ends, marks = pairs.select("a", "b").distinct().limit(limit + 1).collect(), corners.select("x", "y").limit(limit + 1).collect()
    if max(len(ends), len(marks)) > limit:
        raise ValueError(f"more than {limit} shared edges or corners")
    place = {r["pid"]: i for i, r in enumerate(rows)}
    parts = ([[(float(v["x"]), float(v["y"])) for v in r["points"]] for r in rows], [(place[a], place[b]) for a, b in ends], [(float(x), float(y)) for x, y in marks])
    held = polygons.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mesh = None
        for batch in batches:
            mesh = mesh or Mesh(*held.value)
            got = [mesh.shortest((a, b), (c, d)) for a, b, c, d in batch.itertuples(index=False, name=None)]
            yield batch.assign(length=[g[0] for g in got], points=[[{"x": x, "y": y} for x, y in g[1]] for g in got])

    at = ["sx", "sy", "gx", "gy"]
    p = problems.select("id", *(F.col(c).cast("double").alias(c) for c in at))
    solved = p.select(*at).distinct().mapInPandas(run, "sx double, sy double, gx double, gy double, length double, points array<struct<x:double,y:double>>")
    return p.join(solved, at).select("id", "length", "points")


def side(points, x, y):
    """Least cross product of a point with a polygon's edges: above 0 inside, 0 on the border, below 0 outside."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.array_min(F.zip_with(points, nxt, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])))


def classified(points: DataFrame, polygons: DataFrame, bin_width: float = 4.0) -> DataFrame:
    """(id, pid, state) of points (id, x, y) in polygons (pid, points): inside, edge or vertex. Slabs along x turn the
    range join into one on equal numbers."""
    low, high = (F.floor(f(F.transform("points", lambda p: p["x"])) / bin_width) for f in (F.array_min, F.array_max))
    slabs = polygons.withColumn("slab", F.explode(F.sequence(low, high)))
    j = points.withColumn("slab", F.floor(F.col("x") / bin_width)).join(slabs, "slab").withColumn("s", side(F.col("points"), F.col("x"), F.col("y"))).where(F.col("s") > -EPSILON)
    vertex = F.exists("points", lambda p: (F.abs(p["x"] - F.col("x")) < EPSILON) & (F.abs(p["y"] - F.col("y")) < EPSILON))
    return j.select("id", "pid", F.when(vertex, "vertex").when(F.abs("s") < EPSILON, "edge").otherwise("inside").alias("state"))


def from_boxes(boxes: DataFrame) -> DataFrame:
    """(pid, points) of rectangles (x1, y1, x2, y2)."""
    at = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    return boxes.select((F.col("y1") * (1 << 31) + F.col("x1")).alias("pid"), F.array(at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2")).alias("points"))
