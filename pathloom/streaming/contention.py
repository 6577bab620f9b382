"""Units that share a map: no cell ever holds two, the first by its clock takes a cell, and the other waits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import grid as G
from ..operators.paths import node
from ..plans.scratch import discard, stored

#: Fixed-point time of a wait, and of a jump to another place.
WAIT = G.STRAIGHT

#: Turns that a policy tries in order, in eighths of a circle from where a unit faces.
TURNS = {"right_hand": (2, 0, 6, 4), "billiard": (0, 4)}


def placed(cells: DataFrame, units: DataFrame) -> DataFrame:
    """(policy, unit, x, y, d, clock, moves, blocked, distance) of units (policy, unit, x, y) at rest, facing north. Units off
    the open cells are left out, and of several on one cell all but the first."""
    there = units.join(cells.select("x", "y"), ["x", "y"], "left_semi").groupBy("policy", "x", "y").agg(F.min("unit").alias("unit"))
    zero = F.lit(0).cast("long")
    return there.select("policy", "unit", "x", "y", zero.alias("d"), zero.alias("clock"), zero.alias("moves"), zero.alias("blocked"), zero.alias("distance"))


def _wishes(acting: DataFrame, tick: int, legal: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """(policy, unit, clock, k, x2, y2, d2, cost): the cells that units would go to, the best k first."""
    straight = [F.when(F.col("policy") == p, F.array(*(F.struct(F.lit(k).alias("k"), ((F.col("d") + t) % 8).alias("d2")) for k, t in enumerate(turns)))) for p, turns in TURNS.items()]
    drawn = F.when(F.col("policy") == "random", F.array(F.struct(F.lit(0).alias("k"), ((F.col("unit") * 7919 + tick * 104_729) % 8).alias("d2"))))
    walking = acting.select("policy", "unit", "clock", "x", "y", F.explode(F.coalesce(*straight, drawn)).alias("w")).select("policy", "unit", "clock", "x", "y", "w.k", "w.d2")
    walking = walking.join(legal, ["x", "y", "d2"]).select("policy", "unit", "clock", "k", "x2", "y2", "d2", "cost")
    leaping = acting.where("policy = 'teleport'").withColumn("rank", (F.col("unit") * 31 + tick * 17) % max(n, 1)).join(ranks, "rank")
    leaping = leaping.select("policy", "unit", "clock", F.lit(0).alias("k"), "x2", "y2", F.col("d").alias("d2"), F.lit(WAIT).cast("long").alias("cost"))
    return walking.unionByName(leaping)


def ticked(state: DataFrame, wishes: DataFrame, now: int) -> DataFrame:
    """The state (see `placed`) after units whose clock is not past `now` have acted on their wishes. A unit takes its first
    wish that nobody stands on as the tick begins; of several that claim a cell the one with the least clock goes, then the
    least unit, and the others wait where they are. All joins are on a cell or a unit, so a crowded map is many small keys."""
    held = state.select("policy", F.col("x").alias("x2"), F.col("y").alias("y2"))
    free = wishes.join(held, ["policy", "x2", "y2"], "left_anti")
    claim = free.groupBy("policy", "unit").agg(F.min(F.struct("k", "x2", "y2", "d2", "cost", "clock")).alias("w")).select("policy", "unit", "w.*")
    won = claim.groupBy("policy", "x2", "y2").agg(F.min(F.struct("clock", "unit", "d2", "cost")).alias("w")).select("policy", "x2", "y2", "w.unit", "w.d2", "w.cost")
    out, acts, goes = state.join(won, ["policy", "unit"], "left"), F.col("clock") <= now, F.col("x2").isNotNull()
    add = lambda c, v: (F.col(c) + v).alias(c)
    return out.select(
        "policy", "unit", F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y"), F.coalesce("d2", "d").alias("d"),
        add("clock", F.when(goes, F.col("cost")).when(acts, WAIT).otherwise(0)), add("moves", goes.cast("long")), add("blocked", (acts & ~goes).cast("long")),
        add("distance", F.when(goes, F.col("cost")).otherwise(0)),
    )


def contested(cells: DataFrame, units: DataFrame, ticks: int) -> DataFrame:
    """(tick, and the columns of `placed`): where units (policy, unit, x, y) are after each tick, the first being 0.

    Policies: right_hand takes the first free cell of right, ahead, left, back; billiard goes on, or back; random draws one
    of eight moves; teleport draws an open cell. Units of other policies are on maps of their own. Units see each other: a
    cell that is held counts as blocked. Ticks are a straight move apart and a unit acts in one if its clock is not past
    it, so diagonal moves fall behind. A tick is one job over tables, whose result is written to the shared folder. So are
    the cells, once: what they are derived from is read no more often than that, however many joins are on them."""
    cells = stored(cells.select("x", "y"), "cells")
    legal = G.arcs(cells)
    turn = F.coalesce(*(F.when((F.col("x2") - F.col("x") == dx) & (F.col("y2") - F.col("y") == dy), F.lit(k).cast("long")) for k, (dx, dy) in enumerate(G.MOVES)))
    legal = stored(legal.withColumn("d2", turn), "legal")
    ranks = stored(G.ranked(cells.select(node("x", "y").alias("node"))).join(cells.select(node("x", "y").alias("node"), F.col("x").alias("x2"), F.col("y").alias("y2")), "node").select("rank", "x2", "y2"), "ranks")
    n, out = ranks.count(), [stored(placed(cells, units), "tick")]
    for tick in range(ticks):
        now = tick * G.STRAIGHT
        acting = out[-1].where(F.col("clock") <= now)
        out.append(stored(ticked(out[-1], _wishes(acting, tick, legal, ranks, n), now), "tick"))
    discard(cells, legal, ranks)
    return reduce(DataFrame.unionByName, (t.withColumn("tick", F.lit(k).cast("long")) for k, t in enumerate(out)))
