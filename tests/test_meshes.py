"""Mesh paths: equal to those of grids, and right where polygons meet only at a point."""

import math
import random

import pytest

from pathloom.operators import graphs, meshes, paths, visibility
from pathloom.plans import derived, search

SF = "/root/testdata/sf0.001"


def boxes_of(cells):
    """Unit squares, and the pairs that share an edge."""
    place = {c: i for i, c in enumerate(cells)}
    polygons = [[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)] for x, y in cells]
    pairs = [(i, place[(x + dx, y + dy)]) for (x, y), i in place.items() for dx, dy in ((1, 0), (0, 1)) if (x + dx, y + dy) in place]
    return polygons, pairs


@pytest.mark.parametrize("seed", range(4))
def test_mesh_equals_grid(seed):
    g = random.Random(seed)
    cells = sorted({(x, y) for x in range(8) for y in range(8) if g.random() < 0.75})
    field = visibility.Field(cells)
    mesh = meshes.Mesh(*boxes_of(cells), [(float(x), float(y)) for x, y in field.corners])
    for _ in range(25):
        (a, b), (c, d) = g.choice(cells), g.choice(cells)
        if field.near((a, b)) in (6, 9) or field.near((c, d)) in (6, 9):
            continue  # at such a point the grid lets a path begin on both sides
        want, got = field.shortest((a, b), (c, d))[0], mesh.shortest((float(a), float(b)), (float(c), float(d)))[0]
        assert (want is None) == (got is None) and (want is None or abs(want - got) < 1e-6)


def test_square_of_triangles():
    square = [[(0, 0), (1, 0), (0.5, 0.5)], [(1, 0), (1, 1), (0.5, 0.5)], [(1, 1), (0, 1), (0.5, 0.5)], [(0, 1), (0, 0), (0.5, 0.5)]]
    mesh = meshes.Mesh(square, [(0, 1), (1, 2), (2, 3), (3, 0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    assert mesh.shortest((0.0, 0.0), (0.5, 0.5))[0] == pytest.approx(math.sqrt(0.5))
    assert mesh.shortest((0.25, 0.5), (0.75, 0.5))[0] == pytest.approx(0.5)
    assert mesh.shortest((0.5, 0.5), (3.0, 3.0))[0] is None


def test_polygons_that_meet_at_a_point_are_apart():
    cells = [(0, 0), (1, 1)]
    mesh = meshes.Mesh(*boxes_of(cells), [(1.0, 1.0)])
    assert mesh.shortest((0.5, 0.5), (0.9, 0.9))[0] is not None and not mesh.sees((0.5, 0.5), [(1.5, 1.5)])[0]


def test_unpacked_arcs_cost_the_same(spark):
    arcs = paths.numbered(derived.cells(spark, SF).where("x < 12 and y < 12"))
    levels, every = paths.contracted(arcs, core=8)
    got = graphs.unpacked(every)
    both = got.join(every.withColumnRenamed("cost", "c"), ["source", "target"])
    assert both.count() == every.count() and both.where("cost <> c").count() == 0
    q = arcs.selectExpr("source", "target").unionByName(arcs.selectExpr("target as source", "source as target")).distinct().selectExpr("xxhash64(source, target) as id", "source", "target")
    want = {r.id: r.cost for r in paths.solved(q, arcs).collect()}
    assert {r.id: r.cost for r in paths.hierarchy_costs(q, levels, every).collect()} == want


def test_relaxed_costs_are_bounds(spark):
    arcs = paths.numbered(derived.cells(spark, SF))
    graph = search.Graph(*search.collected(arcs))
    start = next(iter(graph.out))
    best = graph.distances(start)
    p = spark.createDataFrame([(i, start, t) for i, t in enumerate(best)], "id long, source long, target long")
    assert all(r.cost >= best[t] for r, t in zip(sorted(graphs.relaxed_costs(p, arcs).collect()), best))
