"""Cones that are propagated by joins over meshes, against sight lines on the grids that the meshes cover."""

import math
import random

import pytest

from pathloom.operators import mesh_intervals as M, visibility


def mesh_of(spark, polygons):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(polygons)]
    return spark.createDataFrame(rows, "pid long, points array<struct<x:double,y:double>>")


def lengths(spark, polygons, problems):
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(problems)], "id long, sx double, sy double, gx double, gy double")
    return {r.id: r.length for r in M.interval_lengths(mesh_of(spark, polygons), asked).collect()}


def triangles(r, cells):
    """Each cell of two units' width as two triangles, cut one way or the other, and listed in either direction."""
    for x, y in cells:
        a, b, c, d = (2 * x, 2 * y), (2 * x + 2, 2 * y), (2 * x + 2, 2 * y + 2), (2 * x, 2 * y + 2)
        for t in ((a, b, c), (a, c, d)) if r.random() < 0.5 else ((a, b, d), (b, c, d)):
            yield list(t) if r.random() < 0.5 else list(t)[::-1]


def strips(cells):
    """Runs of cells of two units' width as one box, so that boxes meet at parts of their edges."""
    for y in sorted({c[1] for c in cells}):
        row = sorted(x for x, v in cells if v == y)
        for x in row:
            if x - 1 not in row:
                end = x
                while end in row:
                    end += 1
                yield [(2 * x, 2 * y), (2 * end, 2 * y), (2 * end, 2 * y + 2), (2 * x, 2 * y + 2)]


@pytest.mark.parametrize("seed, kind", [(1, "triangles"), (2, "strips"), (3, "turned")])
def test_lengths_equal_those_of_the_grid(spark, seed, kind):
    r = random.Random(seed)
    cells = {(x, y) for x in range(7) for y in range(7) if r.random() < 0.72}
    fine = sorted({(2 * x + a, 2 * y + b) for x, y in cells for a in (0, 1) for b in (0, 1)})
    field = visibility.Field(fine)
    polygons = list(strips(cells) if kind == "strips" else triangles(r, cells))
    problems = [tuple(r.randint(0, 14) for _ in range(4)) for _ in range(150)] + [(3, 3, 3, 3), (99, 1, 2, 2), (2, 2, 99, 1)]
    # turned by 3-4-5, edges lie along no axis and all coordinates stay whole
    turn = (lambda x, y: (3 * x - 4 * y, 4 * x + 3 * y)) if kind == "turned" else (lambda x, y: (x, y))
    scale = 5 if kind == "turned" else 1
    got = lengths(spark, [[turn(*p) for p in q] for q in polygons], [(*turn(a, b), *turn(c, d)) for a, b, c, d in problems])
    assert len(got) == len(problems)
    for i, (a, b, c, d) in enumerate(problems):
        want = field.shortest((a, b), (c, d))[0]
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] / scale - want) < 1e-9), (a, b, c, d, got[i], want)
    assert sum(v is not None for v in got.values()) > 30


def test_paths_turn_within_a_fan_and_do_not_pass_between_fans(spark):
    ring = [(math.cos(math.radians(30 * k)), math.sin(math.radians(30 * k))) for k in range(12)]
    polygons = [[(0.0, 0.0), ring[k], ring[(k + 1) % 12]] for k in range(12) if k not in (0, 2)]
    at = lambda degrees, far=0.5: (far * math.cos(math.radians(degrees)), far * math.sin(math.radians(degrees)))
    got = lengths(spark, polygons, [(*at(95), *at(345)), (*at(45), *at(95)), (0.0, 0.0, *at(45)), (*at(345), 0.0, 0.0), (*at(100), *at(200)), (*at(40), *at(50))])
    assert got[0] == pytest.approx(1.0)  # round the vertex, as the straight line leaves the mesh
    assert got[1] is None  # two fans that share the vertex alone
    assert got[2] == pytest.approx(0.5) and got[3] == pytest.approx(0.5)  # a path may begin and end there in any fan
    assert got[4] == pytest.approx(math.dist(at(100), at(200))) and got[5] == pytest.approx(math.dist(at(40), at(50)))


def test_no_polygons_no_problems_and_null_ends(spark):
    square = [[(0, 0), (2, 0), (2, 2), (0, 2)]]
    assert lengths(spark, [], [(0, 0, 1, 1)]) == {0: None}
    assert lengths(spark, square, []) == {}
    asked = spark.createDataFrame([(1, 0.0, None, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "id long, sx double, sy double, gx double, gy double")
    got = sorted((r.id, r.length) for r in M.interval_lengths(mesh_of(spark, square), asked).collect())
    assert got[0] == (1, None) and [g[0] for g in got[1:]] == [2, 2] and all(g[1] == pytest.approx(math.sqrt(2)) for g in got[1:])
