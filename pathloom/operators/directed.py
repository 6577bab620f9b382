"""Searches over cells together with the direction in which they were reached.

A state is a cell and the move that led there. The canonical graph keeps, of all shortest paths that differ in the order of
their moves only, those that move diagonally first, and what a blocked cell forces beside them; each cell then has few
successors in each state. The whole graph has every move in every state, so that turns can be counted. All states of a cell
lead at no cost to the cell's group, whose cost is the least of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans import search
from . import grid as G
from .paths import node

#: Numbers of states: of a cell that no move led to, and of a cell's group. Moves have (dx + 1) * 3 + dy + 1.
START, GROUP, STATES = 4, 9, 16
#: A step's weight beside a turn: costs stay below 2^43, turns below 2^20 and rows of maps below 2^28.
STEP = 1 << 20


def _state(x: str, y: str, code: Column) -> Column:
    return node(x, y) * STATES + code


def _code(dx: Column, dy: Column) -> Column:
    return (dx + 1) * 3 + dy + 1


def successions(cells: DataFrame, canonical: bool = True) -> DataFrame:
    """(x, y, dx, dy, ex, ey, cost): moves (ex, ey) that follow a move (dx, dy) into the cell (x, y). Canonical ones go on, turn
    from a diagonal to one of its two parts, or turn after a straight move towards a side that was blocked one cell before."""
    moves = G.arcs(cells).select("x", "y", "x2", "y2", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"), "cost")
    into = moves.select(F.col("x2").alias("x"), F.col("y2").alias("y"), "dx", "dy")
    both = into.join(moves.select("x", "y", F.col("dx").alias("ex"), F.col("dy").alias("ey"), "cost"), ["x", "y"])
    if not canonical:
        return both
    # the side of the cell before: across the move, towards which the next one leads
    side = both.withColumns({"bx": F.expr("x - dx + if(dx = 0, ex, 0)"), "by": F.expr("y - dy + if(dy = 0, ey, 0)")})
    side = side.join(cells.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(True).alias("free")), ["bx", "by"], "left")
    natural = "if(dx <> 0 and dy <> 0, ex in (0, dx) and ey in (0, dy), ex = dx and ey = dy)"
    forced = "free is null and ((dy = 0 and ey <> 0 and ex in (0, dx)) or (dx = 0 and ex <> 0 and ey in (0, dy)))"
    return side.where(f"{natural} or ({forced})").select("x", "y", "dx", "dy", "ex", "ey", "cost")


def extended(cells: DataFrame, canonical: bool = True, turns: bool = False) -> DataFrame:
    """(source, target, cost) between numbers of states. With turns, a step costs STEP times as much and each turn 1."""
    weight = F.lit(STEP if turns else 1)
    follow = successions(cells, canonical)
    turn = F.expr("cast(dx <> ex or dy <> ey as int)") if turns else F.lit(0)
    after = follow.withColumns({"x2": F.col("x") + F.col("ex"), "y2": F.col("y") + F.col("ey")})
    steps = after.select(_state("x", "y", _code(F.col("dx"), F.col("dy"))).alias("source"), _state("x2", "y2", _code(F.col("ex"), F.col("ey"))).alias("target"), (F.col("cost") * weight + turn).alias("cost"))
    moves = G.arcs(cells).withColumn("code", _code(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    first = moves.select(_state("x", "y", F.lit(START)).alias("source"), _state("x2", "y2", F.col("code")).alias("target"), (F.col("cost") * weight).alias("cost"))
    free = F.lit(0).cast("long").alias("cost")
    group = moves.select(_state("x2", "y2", F.col("code")).alias("source"), _state("x2", "y2", F.lit(GROUP)).alias("target"), free)
    own = cells.select(_state("x", "y", F.lit(START)).alias("source"), _state("x", "y", F.lit(GROUP)).alias("target"), free)
    return steps.unionByName(first).unionByName(group).unionByName(own)


def extended_costs(cells: DataFrame, problems: DataFrame, backward: bool = False) -> DataFrame:
    """(id, cost) of problems (id, sx, sy, gx, gy) by searches over the canonical graph, null where there is no path or an end
    is not open: from the starts to the groups of the goals, or backward from these groups to the starts."""
    arcs = extended(cells)
    todo = problems.select("id", _state("sx", "sy", F.lit(START)).alias("source"), _state("gx", "gy", F.lit(GROUP)).alias("target"))
    if backward:
        arcs = arcs.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
        todo = todo.select("id", F.col("target").alias("source"), F.col("source").alias("target"))
    roots = todo.select("source").distinct()
    far = search.single_source(arcs, roots).withColumnRenamed("node", "target")
    return todo.join(far, ["source", "target"], "left").select("id", "cost")


def fewest_turns(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(sx, sy, x, y, cost, turns): from each source (sx, sy) to each cell that it reaches, the shortest cost and the fewest
    changes of direction among all paths of that cost."""
    roots = sources.select(_state("sx", "sy", F.lit(START)).alias("source")).distinct()
    far = search.single_source(extended(cells, canonical=False, turns=True), roots).where(F.col("node") % STATES == GROUP)
    place = lambda n: (F.expr(f"({n} div {STATES}) % {1 << 31}"), F.expr(f"{n} div {STATES} div {1 << 31}"))
    (sx, sy), (x, y) = place("source"), place("node")
    open_ = cells.select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    out = far.select(sx.alias("sx"), sy.alias("sy"), x.alias("x"), y.alias("y"), F.expr(f"cost div {STEP}").alias("cost"), (F.col("cost") % STEP).alias("turns"))
    return out.join(open_, ["sx", "sy"], "left_semi")
