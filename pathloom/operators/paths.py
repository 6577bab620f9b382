"""Path problems on grids and graphs: searches, hierarchies, first moves, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans import search
from . import grid as G

WIDTH = 1 << 31


def numbered(cells: DataFrame, cut_corners: bool = False) -> DataFrame:
    """(source, target, cost): arcs with cells numbered y * WIDTH + x."""
    a = G.arcs(cells, cut_corners=cut_corners)
    return a.select(node("x", "y").alias("source"), node("x2", "y2").alias("target"), "cost")


def node(x: str, y: str):
    """A cell's number; coordinates are whole numbers from 0 to 2^31 - 1."""
    return F.col(y) * WIDTH + F.col(x)


def _octile(target: int, straight: int = G.STRAIGHT, diagonal: int = G.DIAGONAL):
    tx, ty = target % WIDTH, target // WIDTH

    def h(n: int) -> int:
        dx, dy = abs(n % WIDTH - tx), abs(n // WIDTH - ty)
        return min(dx, dy) * diagonal + abs(dx - dy) * straight

    return h


def solved(problems: DataFrame, arcs: DataFrame, method: str = "astar", scale: int = 1) -> DataFrame:
    """problems (id, source, target) with cost and, of a search, the path and the nodes expanded.

    Methods: astar, dijkstra, bidirectional; astar multiplies its octile estimate by `scale`, and costs are the shortest
    while no arc is cheaper than that. Pairs in different components are not searched: their cost is null. A problem whose
    start is its target costs 0. Graphs too large to be sent to every task are searched in rounds over tables from each
    start, and paths are walked back by joins; nothing is counted as expanded there."""
    arcs = search.scratch(arcs.select("source", "target", "cost"))
    nodes = arcs.select(F.col("source").alias("node")).unionByName(arcs.select(F.col("target").alias("node"))).distinct()
    part = search.scratch(search.components(arcs, nodes))
    p = problems.join(part.select(F.col("node").alias("source"), F.col("component").alias("_a")), "source").join(part.select(F.col("node").alias("target"), F.col("component").alias("_b")), "target")
    todo = p.where("_a = _b").select("source", "target").distinct()  # equal problems are searched once

    def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
        rows, back = [], None
        for s, t in zip(batch["source"].tolist(), batch["target"].tolist()):
            if method == "bidirectional":
                if back is None:
                    flat = [(b, a, c) for a, v in graph.out.items() for b, c in v]
                    back = search.Graph(*map(list, zip(*flat)))
                rows.append((s, t, graph.bidirectional(back, s, t), None, None))
            else:
                h = _octile(t) if method == "astar" else (lambda n: 0)
                cost, path, seen = graph.search(s, t, lambda n: scale * h(n))
                rows.append((s, t, cost, path or None, seen))
        return pd.DataFrame(rows, columns=["source", "target", "cost", "path", "expanded"]).astype({"cost": "Int64", "expanded": "Int64"})

    if search.few(arcs):
        got = search.mapped(todo, arcs, "source long, target long, cost long, path array<long>, expanded long", kernel)
    else:
        far = search.scratch(search.single_source(arcs, todo.select("source").distinct()))
        got = todo.join(far.withColumnRenamed("node", "target"), ["source", "target"]).join(search.walked(todo, far, arcs), ["source", "target"], "left")
        got = got.withColumn("expanded", F.lit(None).cast("long"))
    return problems.select("id", "source", "target").join(got, ["source", "target"], "left")


def path_costs(solutions: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, steps, cost, valid) of the paths: each step is an arc, ends are those asked for, costs are summed again."""
    p = solutions.where("path is not null")
    steps = p.select("id", F.posexplode("path").alias("k", "n"), "source", "target", "cost", F.size("path").alias("size"))
    w = Window.partitionBy("id").orderBy("k")
    steps = steps.withColumn("next", F.lead("n").over(w))
    j = steps.join(arcs.select(F.col("source").alias("n"), F.col("target").alias("next"), F.col("cost").alias("step")), ["n", "next"], "left")
    bad = (F.col("next").isNotNull() & F.col("step").isNull()) | ((F.col("k") == 0) & (F.col("n") != F.col("source"))) | (F.col("next").isNull() & (F.col("n") != F.col("target")))
    out = j.groupBy("id").agg(F.count("step").alias("steps"), F.coalesce(F.sum("step"), F.lit(0)).alias("sum"), F.max("cost").alias("cost"), F.count_if(bad).alias("bad"))
    return out.select("id", "steps", "cost", ((F.col("bad") == 0) & (F.col("sum") == F.col("cost"))).alias("valid"))


def refined(jumps: DataFrame) -> DataFrame:
    """Unit steps of long moves (id, k, x1, y1, x2, y2) along one direction: (id, k, i, x, y)."""
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    rows = jumps.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    sign = lambda a, b: F.signum(F.col(b) - F.col(a)).cast("long")
    return rows.select("id", "k", "i", (F.col("x1") + F.col("i") * sign("x1", "x2")).alias("x"), (F.col("y1") + F.col("i") * sign("y1", "y2")).alias("y"))


def jump_point_costs(cells: DataFrame, problems: DataFrame) -> DataFrame:
    """problems (id, sx, sy, gx, gy) with the cost by jump point search: only forced and natural successors are made,
    and a jump goes on while there is just one."""
    arcs = numbered(cells)
    todo = problems.select("id", node("sx", "sy").alias("source"), node("gx", "gy").alias("target"))
    open_ = cells.select(node("x", "y").alias("node"))
    todo = todo.join(open_.withColumnRenamed("node", "source"), "source", "left_semi").join(open_.withColumnRenamed("node", "target"), "target", "left_semi")

    def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, t, _jps(graph, s, t)) for s, t in zip(batch["source"].tolist(), batch["target"].tolist())]
        return pd.DataFrame(rows, columns=["source", "target", "cost"]).astype({"cost": "Int64"})

    if not search.few(arcs):
        return _by_rounds(todo, arcs)
    got = search.mapped(todo.select("source", "target").distinct(), arcs, "source long, target long, cost long", kernel)
    return todo.join(got, ["source", "target"]).select("id", "cost")


def _by_rounds(todo: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, cost), null where there is no path, for maps that no task can hold: the same costs by rounds over tables."""
    far = search.single_source(arcs, todo.select("source").distinct()).withColumnRenamed("node", "target")
    return todo.join(far, ["source", "target"], "left").select("id", "cost")


def _jps(graph: search.Graph, source: int, target: int) -> int | None:
    import heapq

    legal = graph.__dict__.setdefault("legal", {n: {t - n for t, _ in v} for n, v in graph.out.items()})
    none: set[int] = set()

    def ok(n: int, dx: int, dy: int) -> bool:
        return dy * WIDTH + dx in legal.get(n, none)

    def forced(n: int, dx: int, dy: int) -> list[tuple[int, int]]:
        """Moves that a straight arrival makes necessary: the cell beside the one before was blocked, this one's is open."""
        out, back = [], n - dy * WIDTH - dx
        for sx, sy in ((dy, dx), (-dy, -dx)):
            if ok(n, sx, sy) and not ok(back, sx, sy):
                out.append((sx, sy))
                if ok(n, sx + dx, sy + dy):
                    out.append((sx + dx, sy + dy))
        return out

    def jump(n: int, dx: int, dy: int) -> int | None:
        while ok(n, dx, dy):
            n += dy * WIDTH + dx
            if n == target:
                return n
            if dx and dy:
                if jump(n, dx, 0) is not None or jump(n, 0, dy) is not None:
                    return n
            elif forced(n, dx, dy):
                return n
        return None

    h = _octile(target)
    best, closed, heap = {source: 0}, set(), [(h(source), 0, source, 0, 0)]
    while heap:
        _, g, n, dx, dy = heapq.heappop(heap)
        if n == target:
            return -g
        if (n, dx, dy) in closed or -g > best[n]:
            continue
        closed.add((n, dx, dy))
        if not dx and not dy:
            moves = list(G.MOVES)
        elif dx and dy:
            moves = [(dx, dy), (dx, 0), (0, dy)]
        else:
            moves = [(dx, dy), *forced(n, dx, dy)]
        for mx, my in moves:
            j = jump(n, mx, my)
            if j is not None:
                cost = -g + _octile(n)(j)
                if cost <= best.get(j, cost):
                    best[j] = cost
                    heapq.heappush(heap, (cost + h(j), -cost, j, mx, my))
    return None


def contracted(arcs: DataFrame, core: int = 256) -> tuple[DataFrame, DataFrame]:
    """A contraction hierarchy by rounds: each round removes the nodes whose importance is less than that of all their
    neighbours, until `core` nodes are left, which share the top level. Importance is arcs added per arc removed, plus hops
    added per hop removed, plus the level that contracted neighbours have left behind. In- and out-arcs of a removed node are
    joined to shortcuts, but for those that an arc or a path of two arcs between remaining nodes makes needless.
    (levels (node, level), arcs with shortcuts and mid)."""
    a = arcs.groupBy("source", "target").agg(F.min("cost").alias("cost")).select("source", "target", "cost", F.lit(None).cast("long").alias("mid"), F.lit(1).cast("long").alias("hops"))
    a = search.scratch(a)
    every, levels, level = a, None, 0
    while True:
        both = a.select(F.col("source").alias("node"), F.col("target").alias("other"), "hops").unionByName(a.select(F.col("target").alias("node"), F.col("source").alias("other"), "hops"))
        short = a.select("source", F.col("target").alias("m"), F.col("cost").alias("c1"), F.col("hops").alias("h1")).join(a.select(F.col("source").alias("m"), "target", F.col("cost").alias("c2"), F.col("hops").alias("h2")), "m")
        short = short.where("source <> target").select("source", "target", (F.col("c1") + F.col("c2")).alias("cost"), F.col("m").alias("mid"), (F.col("h1") + F.col("h2")).alias("hops"))
        short = search.scratch(short.join(a.select("source", "target", F.col("cost").alias("now")), ["source", "target"], "left").where("now is null or now > cost").drop("now"))
        added = short.groupBy(F.col("mid").alias("node")).agg(F.count(F.lit(1)).alias("added"), F.sum("hops").alias("longer"))
        rank = both.groupBy("node").agg(F.count(F.lit(1)).alias("gone"), F.sum("hops").alias("shorter"), F.max("hops").alias("far")).join(added, "node", "left")
        worth = F.coalesce(F.col("added") / F.col("gone"), F.lit(0.0)) + F.coalesce(F.col("longer") / F.col("shorter"), F.lit(0.0)) + F.log2("far")
        rank = search.scratch(rank.select("node", F.struct(worth.alias("w"), F.xxhash64("node", F.lit(level)).alias("h"), "node").alias("r")))
        if rank.count() <= core:
            break
        near = both.select("node", "other").join(rank.select(F.col("node").alias("other"), F.col("r").alias("r2")), "other").groupBy("node").agg(F.min("r2").alias("r2"))
        out = search.scratch(rank.join(near, "node").where("r < r2").select("node"))
        mark = out.withColumn("level", F.lit(level))
        levels = mark if levels is None else levels.unionByName(mark)
        rest = search.scratch(a.join(out.withColumnRenamed("node", "source"), "source", "left_anti").join(out.withColumnRenamed("node", "target"), "target", "left_anti"))
        short = short.join(out.withColumnRenamed("node", "mid"), "mid", "left_semi").groupBy("source", "target").agg(F.min(F.struct("cost", "hops", "mid")).alias("b")).select("source", "target", "b.*")
        ways = short.select("source", "target").join(rest.select("source", F.col("target").alias("x"), F.col("cost").alias("c1")), "source").join(rest.select(F.col("source").alias("x"), "target", F.col("cost").alias("c2")), ["x", "target"])
        ways = ways.groupBy("source", "target").agg(F.min(F.col("c1") + F.col("c2")).alias("other"))
        short = short.join(ways, ["source", "target"], "left").where("other is null or other > cost").select("source", "target", "cost", "mid", "hops")
        merged = rest.select("source", "target", "cost", "mid", "hops").unionByName(short).groupBy("source", "target").agg(F.min(F.struct("cost", "hops", F.coalesce("mid", F.lit(-1)).alias("m"))).alias("b"))
        a = search.scratch(merged.select("source", "target", F.col("b.cost").alias("cost"), F.when(F.col("b.m") >= 0, F.col("b.m")).alias("mid"), F.col("b.hops").alias("hops")))
        every = every.unionByName(a)
        level += 1
    nodes = arcs.select(F.col("source").alias("node")).unionByName(arcs.select(F.col("target").alias("node"))).distinct()
    levels = nodes.where(F.lit(False)).withColumn("level", F.lit(0)) if levels is None else levels
    last = nodes.join(levels, "node", "left_anti").withColumn("level", F.lit(level))
    best = every.groupBy("source", "target").agg(F.min(F.struct("cost", F.coalesce("mid", F.lit(-1)).alias("m"))).alias("b"))
    return search.scratch(levels.unionByName(last)), search.scratch(best.select("source", "target", F.col("b.cost").alias("cost"), F.when(F.col("b.m") >= 0, F.col("b.m")).alias("mid")))


def hierarchy_costs(problems: DataFrame, levels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, cost): both ends climb arcs to no lower level only, and only the core has arcs within a level; the least sum at a node that both reach is the cost."""
    lev = lambda c, n: levels.select(F.col("node").alias(c), F.col("level").alias(n))
    ranked = arcs.join(lev("source", "ls"), "source").join(lev("target", "lt"), "target")
    up = search.scratch(ranked.where("ls <= lt").select("source", "target", "cost"))
    down = search.scratch(ranked.where("ls >= lt").select(F.col("target").alias("source"), F.col("source").alias("target"), "cost"))
    sides = []
    for c, a in (("source", up), ("target", down)):
        ends = problems.select(F.col(c).alias("source")).distinct()
        sides.append(search.single_source(a, ends).select(F.col("source").alias(c), "node", F.col("cost").alias(f"cost_{c}")))
    j = problems.select("id", "source", "target").join(sides[0], "source").join(sides[1], ["target", "node"])
    return j.groupBy("id").agg(F.min(F.col("cost_source") + F.col("cost_target")).alias("cost"))


def first_moves(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(source, target, move): the least neighbour of source with which a shortest path to target begins."""

    def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for s in batch["source"].tolist():
            dist = graph.distances(s)
            ways = {s: None}
            for n in sorted(dist, key=dist.get):
                for t, c in graph.out.get(n, ()):
                    if dist[n] + c == dist[t]:
                        m = t if n == s else ways[n]
                        ways[t] = m if t not in ways else min(ways[t], m)
            rows += [(s, t, m) for t, m in ways.items() if t != s]
        return pd.DataFrame(rows, columns=["source", "target", "move"])

    if search.few(arcs):
        return search.mapped(sources, arcs, "source long, target long, move long", kernel)
    # a neighbour begins a shortest path where its arc and its distance make up the source's
    near = search.scratch(arcs.join(sources, "source", "left_semi").select("source", F.col("target").alias("move"), F.col("cost").alias("step")))
    far = search.scratch(search.single_source(arcs, sources.unionByName(near.select(F.col("move").alias("source"))).distinct()))
    own = sources.join(far, "source").select("source", F.col("node").alias("target"), "cost").where("source <> target")
    ways = near.join(far.select(F.col("source").alias("move"), F.col("node").alias("target"), F.col("cost").alias("rest")), "move").join(own, ["source", "target"]).where("step + rest = cost")
    return ways.groupBy("source", "target").agg(F.min("move").alias("move"))


def run_lengths(moves: DataFrame) -> DataFrame:
    """(source, run_begin, move): rows where the first move differs from that of the target before."""
    w = Window.partitionBy("source").orderBy("target")
    return moves.withColumn("before", F.lag("move").over(w)).where("before is null or before <> move").select("source", F.col("target").alias("run_begin"), "move")


def clusters(cells: DataFrame, size: int = 10) -> DataFrame:
    return cells.select("x", "y", F.expr(f"x div {size}").alias("cx"), F.expr(f"y div {size}").alias("cy"))


def jump_table_costs(cells: DataFrame, problems: DataFrame) -> DataFrame:
    """(id, cost) of problems (id, sx, sy, gx, gy) by a search that reads jumps from a table instead of scanning. Beside
    the table's jumps it takes those that pass the target: straight ones end on it, diagonal ones where they come to its
    row or column."""
    arcs, labels = search.scratch(numbered(cells)), search.scratch(G.jump_labels(cells).select(node("x", "y").alias("n"), "dir", "steps"))
    small = search.few(arcs) and search.few(labels, 8 * search.BROADCAST_ARCS)
    held = {(n, d): k for n, d, k in labels.toPandas().itertuples(index=False, name=None)} if small else {}
    table = cells.sparkSession.sparkContext.broadcast(held)
    open_ = cells.select(node("x", "y").alias("node"))
    todo = problems.select("id", node("sx", "sy").alias("source"), node("gx", "gy").alias("target"))
    todo = todo.join(open_.withColumnRenamed("node", "source"), "source", "left_semi").join(open_.withColumnRenamed("node", "target"), "target", "left_semi")

    def solve(graph: search.Graph, source: int, target: int) -> int | None:
        import heapq

        legal = graph.__dict__.setdefault("legal", {n: {t - n for t, _ in v} for n, v in graph.out.items()})
        h, tx, ty = _octile(target), target % WIDTH, target // WIDTH
        best, closed, heap = {source: 0}, set(), [(h(source), 0, source)]

        def run(n: int, step: int, most: int) -> int:
            """Legal steps from n, up to most."""
            k = 0
            while k < most and step in legal.get(n, ()):
                n, k = n + step, k + 1
            return k

        while heap:
            _, g, n = heapq.heappop(heap)
            if n == target:
                return -g
            if n in closed:
                continue
            closed.add(n)
            x, y = n % WIDTH, n // WIDTH
            for (dx, dy), flag in G.FLAGS.items():
                step, ends = dy * WIDTH + dx, {table.value.get((n, flag), 0)}
                ax, ay = (tx - x) * dx, (ty - y) * dy
                if dx and dy:
                    if ax > 0 and ay > 0 and run(n, step, min(ax, ay)) == min(ax, ay):
                        ends.add(min(ax, ay))
                elif (ax > 0 and ty == y) or (ay > 0 and tx == x):
                    if run(n, step, ax + ay) == ax + ay:
                        ends.add(ax + ay)
                for k in ends - {0}:
                    m, cost = n + k * step, -g + k * (G.DIAGONAL if dx and dy else G.STRAIGHT)
                    if cost < best.get(m, cost + 1):
                        best[m] = cost
                        heapq.heappush(heap, (cost + h(m), -cost, m))
        return None

    def kernel(graph: search.Graph, batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, t, solve(graph, s, t)) for s, t in zip(batch["source"].tolist(), batch["target"].tolist())]
        return pd.DataFrame(rows, columns=["source", "target", "cost"]).astype({"cost": "Int64"})

    if not small:
        return _by_rounds(todo, arcs)
    got = search.mapped(todo.select("source", "target").distinct(), arcs, "source long, target long, cost long", kernel)
    return todo.join(got, ["source", "target"]).select("id", "cost")
