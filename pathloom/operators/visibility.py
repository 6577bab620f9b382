"""Any-angle paths and convex regions of grid maps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import grid as G

#: Cells of a map that may be sent to every task.
BROADCAST_CELLS = 2_000_000


class Field:
    """Open cells with exact sight lines between lattice points. A line may touch blocked cells, but not cross one, run
    between two, or pass through a point where two meet corner to corner."""

    def __init__(self, cells: list[tuple[int, int]]) -> None:
        self.open = set(cells)
        self.corners = sorted(p for p in {(x + a, y + b) for x, y in cells for a in (0, 1) for b in (0, 1)} if self.near(p) in (7, 11, 13, 14))
        self._seen: dict[tuple, list] = {}

    def near(self, p: tuple[int, int]) -> int:
        x, y = p
        return sum(bit for a, b, bit in ((0, 0, 1), (-1, 0, 2), (0, -1, 4), (-1, -1, 8)) if (x + a, y + b) in self.open)

    def sees(self, p: tuple[int, int], q: tuple[int, int]) -> bool:
        (x0, y0), (x1, y1) = min(p, q), max(p, q)
        dx, dy, o = x1 - x0, y1 - y0, self.open
        n = math.gcd(dx, abs(dy))
        if any(self.near((x0 + dx // n * k, y0 + dy // n * k)) in (6, 9) for k in range(1, n)):
            return False
        if dx == 0:
            return all((x0, y) in o or (x0 - 1, y) in o for y in range(y0, y1))
        if dy == 0:
            return all((x, y0) in o or (x, y0 - 1) in o for x in range(x0, x1))
        for x in range(x0, x1):  # y * dx is whole at both sides of a column
            a, b = sorted((y0 * dx + (x - x0) * dy, y0 * dx + (x + 1 - x0) * dy))
            if any((x, y) not in o for y in range(a // dx, -(-b // dx))):
                return False
        return True

    def visible(self, p: tuple[int, int]) -> list[tuple[tuple[int, int], float]]:
        """Corners that p sees, with distances."""
        if p not in self._seen:
            self._seen[p] = [(c, math.dist(p, c)) for c in self.corners if c != p and self.sees(p, c)]
        return self._seen[p]

    def shortest(self, p: tuple[int, int], q: tuple[int, int]) -> tuple[float | None, list[tuple[int, int]]]:
        """Length and turning points of a shortest path, which turns at corners only."""
        if not self.near(p) or not self.near(q):
            return None, []
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
            if n in last or (n == p and self.sees(p, q)):
                ways.append((q, math.dist(n, q)))
            for t, w in ways:
                if t not in closed and best[n] + w < best.get(t, math.inf) - 1e-12:
                    best[t], parent[t] = best[n] + w, n
                    heapq.heappush(heap, (best[t] + math.dist(t, q), t))
        return None, []


def any_angle(cells: DataFrame, problems: DataFrame, limit: int = BROADCAST_CELLS) -> DataFrame:
    """(id, length, points) for problems (id, sx, sy, gx, gy) between lattice points; length is null without a path.
    Equal problems are solved once, in tasks that hold the map, whose size is checked."""
    rows = cells.select("x", "y").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} cells")
    field = cells.sparkSession.sparkContext.broadcast(sorted(zip(rows["x"].tolist(), rows["y"].tolist())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = None
        for batch in batches:
            f = f or Field(field.value)
            got = [f.shortest((a, b), (c, d)) for a, b, c, d in batch.itertuples(index=False, name=None)]
            yield batch.assign(length=[g[0] for g in got], points=[[{"x": x, "y": y} for x, y in g[1]] for g in got])

    at = ["sx", "sy", "gx", "gy"]
    solved = problems.select(*at).distinct().mapInPandas(run, "sx long, sy long, gx long, gy long, length double, points array<struct<x:long,y:long>>")
    return problems.join(solved, at).select("id", "length", "points")


def rectangles(cells: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2): the open cells cut into rectangles: runs along x, joined along y while they are equal."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x"))
    runs = cells.withColumn("run", run).groupBy("y", "run").agg(F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"))
    stack = F.col("y") - F.row_number().over(Window.partitionBy("x1", "x2").orderBy("y"))
    return runs.withColumn("stack", stack).groupBy("x1", "x2", "stack").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2")).select("x1", "y1", "x2", "y2")


def located(points: DataFrame, boxes: DataFrame, bin_width: int = 4) -> DataFrame:
    """(id, x1, y1, state) of points (id, x, y) in boxes: inside, on an edge or at a corner. Slabs of `bin_width` turn
    the range join into one on equal numbers; a point at a slab's limit is looked up in both."""
    slabs = boxes.withColumn("slab", F.explode(F.sequence(F.floor(F.col("x1") / bin_width), F.floor(F.col("x2") / bin_width))))
    j = points.withColumn("slab", F.floor(F.col("x") / bin_width)).join(slabs, "slab").where("x between x1 and x2 and y between y1 and y2")
    edge_x, edge_y = (F.col("x") == F.col("x1")) | (F.col("x") == F.col("x2")), (F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2"))
    return j.select("id", "x1", "y1", F.when(edge_x & edge_y, "corner").when(edge_x | edge_y, "edge").otherwise("inside").alias("state"))


def neighbours(boxes: DataFrame) -> DataFrame:
    """(x1, y1, ox1, oy1, length): boxes that share a part of an edge. Edges lie on whole numbers, so they meet by equal
    lines and by the unit pieces that they share."""
    out = None
    for a, b, c, d in (("x2", "x1", "y1", "y2"), ("y2", "y1", "x1", "x2")):
        unit = lambda line, name: boxes.select("x1", "y1", F.col(line).alias("line"), F.explode(F.sequence(F.col(c), F.col(d) - 1)).alias("u")).select("line", "u", F.struct("x1", "y1").alias(name))  # noqa: E731, B023
        rows = unit(a, "p").join(unit(b, "q"), ["line", "u"]).groupBy("p", "q").agg(F.count(F.lit(1)).alias("length"))
        out = rows if out is None else out.unionByName(rows)
    out = out.unionByName(out.select(F.col("q").alias("p"), F.col("p").alias("q"), "length"))
    return out.select("p.x1", "p.y1", F.col("q.x1").alias("ox1"), F.col("q.y1").alias("oy1"), "length")


def merged(boxes: DataFrame) -> DataFrame:
    """(map, x1, y1, x2, y2) with boxes of a map joined in pairs that make a box again, the largest result first, until
    no two do. The order is sequential within a map; maps are joined side by side."""

    def join(p: pd.DataFrame) -> pd.DataFrame:
        left = {tuple(map(int, r)) for r in p[["x1", "y1", "x2", "y2"]].itertuples(index=False)}

        def partners(b: tuple) -> list[tuple]:
            x1, y1, x2, y2 = b
            near = [o for o in by_edge.get(("x", x2, y1, y2), ())] + [o for o in by_edge.get(("y", y2, x1, x2), ())]
            return [(-(max(x2, o[2]) - x1) * (max(y2, o[3]) - y1), b, o) for o in near]

        by_edge: dict[tuple, set] = {}
        for b in left:
            by_edge.setdefault(("x", b[0], b[1], b[3]), set()).add(b)
            by_edge.setdefault(("y", b[1], b[0], b[2]), set()).add(b)
        heap = [h for b in left for h in partners(b)]
        heapq.heapify(heap)
        while heap:
            _, a, b = heapq.heappop(heap)
            if a not in left or b not in left:
                continue
            left -= {a, b}
            for o in (a, b):
                by_edge[("x", o[0], o[1], o[3])].discard(o)
                by_edge[("y", o[1], o[0], o[2])].discard(o)
            new = (a[0], a[1], b[2], b[3])
            left.add(new)
            by_edge.setdefault(("x", new[0], new[1], new[3]), set()).add(new)
            by_edge.setdefault(("y", new[1], new[0], new[2]), set()).add(new)
            before = [(-(new[2] - o[0]) * (new[3] - o[1]), o, new) for o in left if (o[2], o[1], o[3]) == (new[0], new[1], new[3]) or (o[3], o[0], o[2]) == (new[1], new[0], new[2])]
            for h in partners(new) + before:
                heapq.heappush(heap, h)
        return pd.DataFrame([(p["map"].iloc[0], *b) for b in sorted(left)], columns=["map", "x1", "y1", "x2", "y2"])

    return boxes.groupBy("map").applyInPandas(join, "map string, x1 long, y1 long, x2 long, y2 long")
