"""Abstract graphs and shared maps on small maps, against plain searches and what must hold."""

import random

from pathloom.operators import abstraction, contraction, grid, hierarchies, paths
from pathloom.plans import derived, search
from pathloom.queries import streams
from pathloom.streaming import contention


def _cells(spark, side, share, seed):
    g = random.Random(seed)
    at = [(x, y) for x in range(side) for y in range(side) if g.random() < share]
    return spark.createDataFrame(at, "x long, y long"), at


def test_refined_paths_are_legal_and_near_the_shortest(spark):
    cells, at = _cells(spark, 17, 0.8, 3)
    g = random.Random(4)
    ask = [(k, *(y * paths.WIDTH + x for x, y in (g.choice(at), g.choice(at)))) for k in range(40)] + [(40, at[0][1] * paths.WIDTH + at[0][0], at[0][1] * paths.WIDTH + at[0][0])]
    problems = spark.createDataFrame(ask, "id long, source long, target long")
    arcs = paths.numbered(cells)
    graph = search.Graph(*search.collected(arcs))
    found = {n: abstraction.hierarchical(problems, cells, n) for n in ((4,), (4, 8, 16))}
    costs = [{r.id: r.cost for r in df.collect()} for df in found.values()]
    assert costs[0] == costs[1]  # levels change no cost
    for k, s, t in ask:
        best = graph.distances(s).get(t)
        assert (k in costs[0]) == (best is not None)
        if best is not None:
            assert costs[0][k] >= best and (s != t or costs[0][k] == 0)
    checked = paths.path_costs(found[(4, 8, 16)], arcs).collect()
    assert len(checked) == len(costs[0]) and all(r.valid for r in checked)


def test_no_problems_no_paths(spark):
    cells, _ = _cells(spark, 5, 1.0, 1)
    none = spark.createDataFrame([], "id long, source long, target long")
    assert abstraction.hierarchical(none, cells, (4,)).count() == 0


def test_no_cell_is_held_twice(spark):
    cells, at = _cells(spark, 6, 0.8, 7)
    units = [(p, k, *at[k % len(at)]) for p in ("random", "right_hand", "billiard", "teleport") for k in range(len(at) + 3)] + [("random", 99, 77, 77)]
    out = contention.contested(cells, spark.createDataFrame(units, "policy string, unit long, x long, y long"), 5).toPandas()
    assert not out.duplicated(["policy", "tick", "x", "y"]).any() and not out.duplicated(["policy", "tick", "unit"]).any()
    assert set(zip(out.x, out.y)) <= set(at) and 99 not in set(out.unit) and out.unit.max() < len(at)
    assert (out.groupby(["policy", "tick"]).size() == len(at)).all()  # every cell is held, so nobody ever moves
    assert out.moves.max() == 0 and (out[out.tick == 5].blocked == 5).all()


def test_cells_are_derived_once(spark, monkeypatch):
    """Of the shared maps: the map and the crowd are taken from one reading of the line items."""
    read, cells = spark.sparkContext.accumulator(0), derived.cells

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(derived, "cells", lambda s, d: cells(s, d).mapInArrow(counted, "x long, y long"))
    got = streams.QUERIES["sm04_travelled"](spark, "/root/testdata/sf0.001").count()
    assert got == 4 * (streams.TICKS + 1) and read.value == cells(spark, "/root/testdata/sf0.001").count()


def test_the_first_by_clock_takes_the_cell(spark):
    row = spark.createDataFrame([(x, 0) for x in range(3)], "x long, y long")
    state = contention.placed(row, spark.createDataFrame([("random", 1, 0, 0), ("random", 2, 2, 0)], "policy string, unit long, x long, y long"))
    state = state.selectExpr("policy", "unit", "x", "y", "d", "case when unit = 1 then 5L else clock end as clock", "moves", "blocked", "distance")
    wish = spark.createDataFrame([("random", 1, 5, 0, 1, 0, 2, 10000), ("random", 2, 0, 0, 1, 0, 6, 10000)], "policy string, unit long, clock long, k int, x2 long, y2 long, d2 long, cost long")
    got = {r.unit: (r.x, r.clock, r.moves, r.blocked, r.distance) for r in contention.ticked(state, wish, 10).collect()}
    assert got == {1: (0, 10005, 0, 1, 0), 2: (1, 10000, 1, 0, 10000)}


def test_levels_keep_costs_and_direct_shortcuts(spark):
    cells, at = _cells(spark, 8, 0.75, 11)
    arcs = search.scratch(paths.numbered(cells))
    sub = search.scratch(grid.subgoals(cells).select(paths.node("x", "y").alias("source")))
    plain = hierarchies.subgoal_graph(sub, arcs)
    levels, graph = contraction.r_contracted(plain)
    level, rows = {r.node: r.level for r in levels.collect()}, graph.collect()
    assert max(level.values()) > 0
    far = lambda a, b: (lambda dx, dy: min(dx, dy) * 14142 + abs(dx - dy) * 10000)(abs(a % paths.WIDTH - b % paths.WIDTH), abs(a // paths.WIDTH - b // paths.WIDTH))
    assert all(r.cost == far(r.source, r.target) for r in rows)
    assert all(level[r.source] != level[r.target] or level[r.source] == max(level.values()) for r in rows)
    full = search.Graph(*search.collected(plain))
    up = search.Graph(*map(list, zip(*((r.source, r.target, r.cost) for r in rows if level[r.source] <= level[r.target]))))
    climbs = {n: up.distances(n) for n in level}
    for s in level:
        want = full.distances(s)
        for t in level:
            met = [c + climbs[t][n] for n, c in climbs[s].items() if n in climbs[t]]
            assert (min(met) if met else None) == want.get(t)
