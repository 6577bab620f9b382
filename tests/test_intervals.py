"""Intervals that are propagated by joins against sight lines that are searched one by one."""

import random

import pytest

from pathloom.operators import intervals, visibility


def tables(spark, cells, problems):
    return spark.createDataFrame(sorted(cells), "x long, y long"), spark.createDataFrame(problems, "id long, sx long, sy long, gx long, gy long")


@pytest.mark.parametrize("seed, width, height, share", [(1, 9, 9, 0.7), (2, 23, 5, 0.8), (3, 4, 21, 0.6)])
def test_lengths_equal_those_of_sight_lines(spark, monkeypatch, seed, width, height, share):
    monkeypatch.setattr(intervals, "BIN", 3)  # intervals and runs of several bins
    monkeypatch.setattr(intervals, "ROWS", 3)
    r = random.Random(seed)
    cells = {(x, y) for x in range(width) for y in range(height) if r.random() < share}
    problems = [(i, r.randint(0, width), r.randint(0, height), r.randint(0, width), r.randint(0, height)) for i in range(120)]
    problems += [(200, 1, 1, 1, 1), (201, width + 3, 1, 0, 0), (202, 0, 0, width + 3, 1), *[(300 + i, *problems[0][1:]) for i in range(3)]]
    own, asked = tables(spark, cells, problems)
    field = visibility.Field(sorted(cells))
    got = {x.id: x.length for x in intervals.interval_lengths(own, asked).collect()}
    assert len(got) == len(problems)
    for i, a, b, c, d in problems:
        want = field.shortest((a, b), (c, d))[0]
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9), (i, a, b, c, d, got[i], want)


def test_arcs_lie_between_points_that_see_each_other(spark):
    r = random.Random(9)
    cells = {(x, y) for x in range(8) for y in range(8) if r.random() < 0.75}
    own, none = spark.createDataFrame(sorted(cells), "x long, y long"), spark.createDataFrame([], "x long, y long")
    field = visibility.Field(sorted(cells))
    arcs = {((a.x, a.y), (a.tx, a.ty)) for a in intervals.sight_arcs(own, none, none).collect()}
    assert all(field.sees(p, q) for p, q in arcs) and {(q, p) for p, q in arcs} == arcs
    turn = {(c.x, c.y): c.turn for c in intervals.corners(intervals.surroundings(own)).collect()}
    taut = lambda p, q: all((q[0] - p[0]) * (q[1] - p[1]) * turn[e] <= 0 for e in (p, q))
    assert {(p, q) for p in turn for q in turn if p[1] != q[1] and field.sees(p, q) and taut(p, q)} == {(p, q) for p, q in arcs if p[1] != q[1]}


def test_no_cells_and_no_problems(spark):
    own, asked = tables(spark, [], [(1, 0, 0, 1, 1)])
    assert [tuple(r) for r in intervals.interval_lengths(own, asked).collect()] == [(1, None, None)]
    own, asked = tables(spark, [(0, 0)], [])
    assert intervals.interval_lengths(own, asked).count() == 0


def test_followed_moves_are_shortest_paths(spark):
    from pathloom.operators import hierarchies, paths
    from pathloom.plans import search

    r = random.Random(5)
    cells = {(x, y) for x in range(9) for y in range(9) if r.random() < 0.65}
    own = spark.createDataFrame(sorted(cells), "x long, y long")
    arcs = paths.numbered(own)
    nodes = [y * paths.WIDTH + x for x, y in sorted(cells)]
    problems = [(i, r.choice(nodes), r.choice(nodes)) for i in range(150)] + [(500, nodes[0], nodes[0]), (501, 10**12, nodes[0])]
    table = paths.run_lengths(paths.first_moves(spark.createDataFrame([(n,) for n in nodes], "source long"), arcs))
    got = {x.id: (x.cost, x.steps) for x in hierarchies.followed(spark.createDataFrame(problems, "id long, source long, target long"), table, arcs).collect()}
    graph = search.Graph(*search.collected(arcs))
    min_step, max_step = (f(c for v in graph.out.values() for _, c in v) for f in (min, max))
    for i, s, t in problems:
        cost, path, _ = graph.search(s, t)
        assert (got.get(i) or (None,))[0] == cost, (i, s, t)
        if cost:
            assert graph.out and got[i][1] * min_step <= cost <= got[i][1] * max_step

