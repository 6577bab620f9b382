"""States of cell and direction against plain searches and brute force."""

import heapq
import random

import pytest

from pathloom.operators import directed, paths
from pathloom.plans import search


def moves(cells):
    for x, y in cells:
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                if (dx or dy) and {(x + dx, y + dy), (x + dx, y), (x, y + dy)} <= cells:
                    yield (x, y), (dx, dy), 14142 if dx and dy else 10000


def turns_of(cells, source):
    """The least (cost, turns) to each cell, by a search over states."""
    out, best, heap = {}, {}, [(0, 0, source, None)]
    for p, d, c in moves(cells):
        out.setdefault(p, []).append((d, c))
    while heap:
        cost, turns, p, d = heapq.heappop(heap)
        if (p, d) in best:
            continue
        best[p, d] = (cost, turns)
        for e, c in out.get(p, ()):
            heapq.heappush(heap, (cost + c, turns + (d is not None and e != d), (p[0] + e[0], p[1] + e[1]), e))
    least = {}
    for (p, _), v in best.items():
        least[p] = min(v, least.get(p, v))
    return least


@pytest.mark.parametrize("seed, limit", [(1, None), (2, None), (3, 3)])
def test_costs_and_turns_equal_brute_force(spark, monkeypatch, seed, limit):
    r = random.Random(seed)
    side = 4 if limit else 9
    if limit:
        monkeypatch.setattr(search, "BROADCAST_ARCS", limit)  # rounds over tables
    cells = {(x, y) for x in range(side) for y in range(side) if r.random() < 0.75}
    own = spark.createDataFrame(sorted(cells), "x long, y long")
    ends = sorted(cells)
    problems = [(i, *r.choice(ends), *r.choice(ends)) for i in range(60)] + [(100, *ends[0], *ends[0]), (101, *ends[0], 50, 50), (102, 50, 50, *ends[0]), (103, 50, 50, 50, 50)]
    asked = spark.createDataFrame(problems, "id long, sx long, sy long, gx long, gy long")
    least = {s: turns_of(cells, s) for s in {(p[1], p[2]) for p in problems} & cells}
    want = {i: least.get((a, b), {}).get((c, d), (None, None))[0] for i, a, b, c, d in problems}
    for backward in (False, True):
        assert {x.id: x.cost for x in directed.extended_costs(own, asked, backward).collect()} == want
    starts = ends[:2]
    got = directed.fewest_turns(own, spark.createDataFrame([*starts, starts[0], (50, 50)], "sx long, sy long")).collect()
    assert {((x.sx, x.sy), (x.x, x.y)): (x.cost, x.turns) for x in got} == {(s, t): v for s in starts for t, v in turns_of(cells, s).items()}
    assert len(got) == sum(len(turns_of(cells, s)) for s in starts)


def test_canonical_states_have_fewer_successors(spark):
    own = spark.createDataFrame([(x, y) for x in range(6) for y in range(6)], "x long, y long")
    # without obstacles nothing is forced: one successor after a straight move, up to three after a diagonal one
    most = directed.successions(own).groupBy("x", "y", "dx", "dy").count().groupBy((directed.F.col("dx") * directed.F.col("dy") != 0).alias("diagonal")).agg(directed.F.max("count").alias("most")).collect()
    assert {m.diagonal: m.most for m in most} == {False: 1, True: 3}
    assert directed.successions(own.where("x > 99")).count() == 0 and paths.numbered(own).count() > 0
