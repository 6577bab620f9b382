"""Every query with an SQL form against DuckDB on the smallest tables, and the others against what must hold."""

import math
import random

import pytest

duckdb = pytest.importorskip("duckdb")

from pathloom import catalog  # noqa: E402
from pathloom.operators import graphs, grid, hierarchies, paths, visibility  # noqa: E402
from pathloom.plans import derived, search  # noqa: E402
from pathloom.sources import maps  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    def plain(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLES)))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_any_angle_lies_between(spark):
    """Straight lines bound any-angle lengths from below, and lattice paths from above."""
    cells = derived.cells(spark, SF)
    p = derived.problems(spark, SF).limit(60)
    got = {r.id: r.length for r in visibility.any_angle(cells, p).collect()}
    arcs = grid.point_arcs(cells).select(paths.node("px", "py").alias("source"), paths.node("qx", "qy").alias("target"), "cost")
    graph = search.Graph(*search.collected(arcs))
    for r in p.collect():
        cost = graph.distances(r.sy * paths.WIDTH + r.sx).get(r.gy * paths.WIDTH + r.gx)
        if got[r.id] is not None:
            assert got[r.id] >= math.dist((r.sx, r.sy), (r.gx, r.gy)) - 1e-9
            if cost is not None:
                assert got[r.id] <= cost / 10000 + 1e-3


def test_sight_lines():
    f = visibility.Field([(x, y) for x in range(4) for y in range(4) if (x, y) != (1, 1)])
    assert not f.sees((0, 0), (4, 4)) and f.sees((0, 1), (4, 1)) and f.sees((2, 1), (4, 4)) and not f.sees((0, 0), (3, 2))
    length, points = f.shortest((0, 0), (4, 4))
    assert length == pytest.approx(math.dist((0, 0), (1, 2)) + math.dist((1, 2), (4, 4))) and len(points) == 3
    across = visibility.Field([(0, 0), (1, 1)])
    assert not across.sees((0, 0), (2, 2)) and across.shortest((0, 0), (2, 2))[0] is None


def test_searches_agree_on_random_maps(spark):
    g = random.Random(5)
    cells = [(x, y) for x in range(14) for y in range(14) if g.random() < 0.75]
    df = spark.createDataFrame(cells, "x long, y long")
    arcs = paths.numbered(df)
    graph = search.Graph(*search.collected(arcs))
    pairs = [(*g.choice(cells), *g.choice(cells)) for _ in range(40)]
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(pairs)], "id long, sx long, sy long, gx long, gy long")
    want = {i: graph.distances(v[1] * paths.WIDTH + v[0]).get(v[3] * paths.WIDTH + v[2]) for i, v in enumerate(pairs)}
    assert {r.id: r.cost for r in paths.jump_point_costs(df, p).collect()} == want
    q = p.select("id", paths.node("sx", "sy").alias("source"), paths.node("gx", "gy").alias("target"))
    for method in ("astar", "dijkstra", "bidirectional"):
        assert {r.id: r.cost for r in paths.solved(q, arcs, method).collect()} == want
    checked = paths.path_costs(paths.solved(q, arcs), arcs).collect()
    assert checked and all(r.valid for r in checked)


def test_rounds_equal_kernel(spark):
    cells = derived.cells(spark, SF).where("x < 9 and y < 9")
    arcs = paths.numbered(cells)
    one = arcs.selectExpr("min(source) as source")
    a = {(r.node, r.cost) for r in search.single_source(arcs, one).collect()}
    b = {(r.node, r.cost) for r in search.single_source(arcs, one, limit=0).collect()}
    c = {(r.node, r.cost) for r in search.rounds(arcs, one.selectExpr("source as node", "0L as cost")).collect()}
    nodes = cells.select(paths.node("x", "y").alias("node"))
    assert a == b == c
    assert sorted(search.components(arcs, nodes).collect()) == sorted(search.components(arcs, nodes, limit=0).collect())


def test_searches_go_on_beyond_the_limit(spark, monkeypatch):
    """Graphs that no task may hold give the same costs, paths, first moves and components."""
    g = random.Random(6)
    cells = [(x, y) for x in range(7) for y in range(7) if g.random() < 0.8]
    df = spark.createDataFrame(cells, "x long, y long")
    arcs = paths.numbered(df)
    p = spark.createDataFrame([(i, *g.choice(cells), *g.choice(cells)) for i in range(6)], "id long, sx long, sy long, gx long, gy long")
    q = p.select("id", paths.node("sx", "sy").alias("source"), paths.node("gx", "gy").alias("target"))
    own = q.select("source").distinct()
    directed = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)], "source long, target long")

    def all_of():
        solved = paths.solved(q, arcs)
        return [
            sorted((r.id, r.cost) for r in solved.collect()), all(r.valid for r in paths.path_costs(solved, arcs).collect()), sorted(map(tuple, paths.first_moves(own, arcs).collect())),
            sorted((r.id, r.cost) for r in paths.jump_point_costs(df, p).collect()), sorted((r.id, r.cost) for r in paths.jump_table_costs(df, p).collect()),
            sorted(map(tuple, hierarchies.freespace(arcs, own).collect())), sorted((r["node"], r["component"]) for r in graphs.strong_components(directed.selectExpr("*", "1L as cost")).collect()),
        ]

    want = all_of()
    monkeypatch.setattr(search, "BROADCAST_ARCS", 3)
    assert all_of() == want and want[6] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]


def test_merged_boxes_cannot_be_joined_further(spark):
    boxes = visibility.merged(visibility.rectangles(derived.cells(spark, SF)).selectExpr("'m' as map", "*")).collect()
    right = {(r.x1, r.y1, r.y2) for r in boxes}
    below = {(r.y1, r.x1, r.x2) for r in boxes}
    assert not any((r.x2, r.y1, r.y2) in right or (r.y2, r.x1, r.x2) in below for r in boxes)


def test_wide_maps_have_numbers_of_their_own(spark):
    far = spark.createDataFrame([(65536, 0), (0, 1), (65537, 0), (1, 1)], "x long, y long")
    assert far.select(paths.node("x", "y").alias("n")).distinct().count() == 4
    assert sorted(r.cost for r in paths.numbered(far).collect()) == [10000] * 4


def test_strategies_can_be_added(spark, monkeypatch):
    from pathloom.plans import strategies

    class Nothing:
        def preprocess(self, cells):
            return {"cells": cells}

        def query(self, prepared, problems):
            return problems.selectExpr("id", "7L as cost")

    monkeypatch.setitem(strategies.ALGORITHMS, "nothing", Nothing())
    p = spark.createDataFrame([(1, 0, 0)], "id long, source long, target long")
    assert [tuple(r) for r in strategies.compared(p, derived.cells(spark, SF), ["nothing"]).collect()] == [("nothing", 1, 7)]
    arcs = paths.numbered(derived.cells(spark, SF))
    relation = strategies.RELATIONS["freespace"]
    one = arcs.selectExpr("min(source) as source")
    reached = relation.connect(arcs, one)
    asked = reached.selectExpr("node as id", "source", "node as target")
    assert reached.count() > 0 and relation.reachable(arcs, asked).where("not reachable").count() == 0


def test_readers_refuse_bad_files(spark):
    texts = [("a", "type octile\nheight 2\nwidth 3\nmap\n...\n.@.\n"), ("b", "height 2\ntype octile\nwidth 3\nmap\n..\n.@.\n"), ("c", "type other\nheight 1\nwidth 1\nmap\n.\n"), ("d", "width 1\nheight 1\ntype octile\nmap\nG")]
    df = spark.createDataFrame(texts, "file string, value string")
    assert {r.file: r.n for r in maps.parse_maps(df).groupBy("file").agg({"*": "count"}).toDF("file", "n").collect()} == {"a": 6, "d": 1}
    scen = [("v1", "version 1.0\n0\tm\t4\t4\t0\t0\t3\t3\t4.24\nbad line\n"), ("v3", "3\nm 1 2 3 4 5.5\n"), ("v2", "2\nm 1 2 3 4 5.5 6 7\n")]
    got = {r.file: r for r in maps.parse_problems(maps.lines(spark.createDataFrame(scen, "file string, value string"))).collect()}
    assert set(got) == {"v1", "v3"} and got["v1"].precision == 2 and got["v3"].map_w == 1 and got["v3"].gy == 4
    mesh = "mesh 2 1 1 0 0 1 0 3 0 0 0 -1 -1 -1 9"
    parsed = maps.parse_meshes(spark.createDataFrame([("ok", "mesh\n2\n4 2\n0 0 3 0 1 -1\n1 0 2 0 -1\n1 1 3 1 0 -1\n0 1 2 1 -1\n3 0 1 2 -1 -1 1\n3 0 2 3 0 -1 -1\n"), ("bad", mesh), ("short", "mesh 2 1")], "file string, value string"))
    assert {r.file for r in parsed.where("kind = 'error'").collect()} == {"bad", "short"}
    assert maps.mesh_vertices(parsed).where("is_corner").count() == 4 and maps.mesh_polygons(parsed).where("is_one_way").count() == 2
    assert maps.unpacked(maps.packed([0, -1, 70000])) == [0, -1, 70000]


def test_small_readers(spark):
    f = spark.createDataFrame([("i", "2\n1 2\n3 4\n5 6\n")], "file string, value string")
    assert [(r.a, r.b) for r in maps.parse_instances(maps.lines(f), ["a", "b"]).orderBy("row_id").collect()] == [(1, 2), (3, 4)]
    t = spark.createDataFrame([("t", "popped root=(1.5, 2)\nnothing\n generating 3e1\n")], "file string, value string")
    assert [(r.event, r.numbers) for r in maps.parse_trace(maps.lines(t)).orderBy("row_id").collect()] == [("popped", [1.5, 2.0]), ("generating", [30.0])]
    m = spark.createDataFrame([("m", "0 1 2 1 22000 1 0 2 0\n0 0 1 0 5\n1 2\n")], "file string, value string")
    assert [(r.cost, len(r.swept)) for r in maps.parse_primitives(maps.lines(m)).orderBy("cost").collect()] == [(5, 0), (22000, 2)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
