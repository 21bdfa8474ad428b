import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import network, terrain


def graph(spark, seed=1, n=40, m=70):
    rng = random.Random(seed)
    nodes = [(k, rng.uniform(-100, 100), rng.uniform(-100, 100)) for k in range(n)]
    edges = [(k, *rng.sample(range(n), 2), rng.choice(["local", "arterial", "collector", "shore"]), 8.0, rng.random() < 0.1) for k in range(m)]
    return nodes, edges, spark.createDataFrame(nodes, "node long, x double, z double"), spark.createDataFrame(edges, "edge long, a long, b long, cls string, width double, removed boolean")


def brute_reach(nodes, edges, start, budget):
    at = {k: (x, z) for k, x, z in nodes}
    steps = {}
    for _, a, b, cls, _, gone in edges:
        if not gone and cls != "shore":
            d = math.dist(at[a], at[b])
            steps.setdefault(a, []).append((b, d))
            steps.setdefault(b, []).append((a, d))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        for m, w in steps.get(n, ()):
            if d + w <= budget and d + w < best.get(m, math.inf):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return best


def test_reach_is_dijkstra(spark):
    nodes, edges, n, e = graph(spark)
    starts = spark.createDataFrame([(0,), (3,), (999,)], "start long")
    got = {}
    for r in network.reach(n, e, starts, 200.0).collect():
        got.setdefault(r.start, {})[r.node] = r.distance
    assert set(got) == {0, 3}
    for s, found in got.items():
        expected = brute_reach(nodes, edges, s, 200.0)
        assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k], abs_tol=1e-9) for k in found)
    with pytest.raises(ValueError):
        network.reach(n, e, starts, -1.0)


def test_small_budget(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 9.0), (4, 40.0, 0.0)], "node long, x double, z double")
    e = spark.createDataFrame([(0, 0, 1, "local"), (1, 1, 2, "local"), (2, 0, 3, "local"), (3, 2, 4, "local"), (4, 3, 4, "boundary")], "edge long, a long, b long, cls string")
    found = network.reach(n, e, spark.createDataFrame([(0,)], "start long"), 10.0)
    assert sorted((r.node, r.distance) for r in found.collect()) == [(0, 0.0), (1, 5.0), (2, 10.0), (3, 9.0)]
    assert sorted(r.edge for r in network.reached_edges(found, n, e, 10.0).collect()) == [0, 1, 2]


def test_adjacency_and_traffic(spark):
    _, edges, n, e = graph(spark, 2)
    live = [x for x in edges if not x[5] and x[3] != "shore"]
    steps = network.adjacency(n, e)
    assert steps.count() == 2 * len(live)
    assert all([s.edge for s in r.steps] == sorted(s.edge for s in r.steps) for r in network.adjacency_lists(steps).collect())
    used = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2)], "route long, pos int, edge long")
    got = {r.edge: r.traffic for r in network.edge_traffic(e, used).collect()}
    assert got[1] == 2 and got[2] == 1 and got[3] == 0 and len(got) == len(edges)
    heat = {r.edge: r.heat for r in network.traffic_heat(network.edge_traffic(e, used)).collect()}
    assert heat[1] == 1.0 and math.isclose(heat[2], math.sqrt(0.5)) and heat[3] == 0.0


def test_positions(spark):
    steps = spark.createDataFrame([(1, 0, 10, 0.0, 0.0, 10.0, 0.0, 8.0, False, False, 0.0), (1, 1, 11, 10.0, 0.0, 10.0, 10.0, 8.0, True, False, 1.0)], "car long, pos int, edge long, fx double, fz double, tx double, tz double, width double, bridge boolean, tunnel boolean, level double")
    cars = spark.createDataFrame([(1, 0.0, 1.0, e) for e in (0.0, 5.0, 15.0, 20.0, 25.0, 40.0)], "car long, t double, speed double, elapsed double")
    got = {r.elapsed: r for r in network.positions(cars, steps).collect()}
    assert len(got) == 6
    assert (got[0.0].x, got[0.0].z) == (0.0, 0.0) and (got[5.0].x, got[5.0].edge) == (5.0, 10) and got[5.0].z == -2.0
    assert got[15.0].edge == 11 and got[15.0].elevated and got[15.0].bridge
    assert math.isclose(got[25.0].z, 5.0) and got[25.0].x < 10 < got[15.0].x  # the other side on the way back
    assert (got[40.0].x, got[40.0].z) == (0.0, 0.0)


def test_caps(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 0.0), (3, 10.0, 10.0), (4, 30.0, 0.0)], "node long, x double, z double")
    e = spark.createDataFrame([(0, 0, 1, "local", 8.0, 0.0), (1, 1, 2, "local", 8.0, 0.0), (2, 1, 3, "arterial", 20.0, 0.0), (3, 2, 4, "local", 8.0, 0.0)], "edge long, a long, b long, cls string, width double, level double")
    assert sorted((r.node, r.r) for r in network.junction_caps(n, e).collect()) == [(1, 10.0)]
    assert {r.kind for r in network.ribbons(n, e).collect()} == {"road"}


def test_bridge_runs(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.25, 0.0, 20.0, 0.0), (3, 50.0, 0.0, 60.0, 0.0)], "bridge long, ax double, az double, bx double, bz double")
    height = lambda x, z: x
    got = {r.bridge: (r.run, r.deck) for r in terrain.run_decks(terrain.deck_heights(b, height, 1.0)).collect()}
    assert got == {1: (1, 21.0), 2: (1, 21.0), 3: (3, 61.0)}
    grades = terrain.max_grade(b, height).collect()
    assert all(math.isclose(r.grade, 1.0) for r in grades)
    wet = terrain.water_offences(b.select(F.col("bridge").alias("edge"), "ax", "az", "bx", "bz"), lambda x, z: F.lit(15.0) - x)
    assert sorted(r.edge for r in wet.collect()) == [2, 3]


def test_reports(spark):
    c = spark.createDataFrame([(0, 5.0, 1), (1, 9.0, 3), (2, 9.0, 2), (3, 1.0, 3)], "seq int, length double, traffic int")
    assert [r.seq for r in network.top_streets(c, 3).collect()] == [1, 2, 0]
    assert [r.seq for r in network.top_traffic(c).collect()] == [1, 3, 2]
    own = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (1, 0, 12), (2, 0, 13)], "corridor int, pos int, edge int")
    lengths = spark.createDataFrame([(10, 150.0, "arterial"), (11, 150.0, "arterial"), (12, 90.0, "arterial"), (13, 500.0, "local")], "edge int, length double, cls string")
    assert [(r.corridor, r.edge) for r in network.label_edges(own, lengths).collect()] == [(0, 10)]
    assert [r.length for r in network.route_lengths(spark.createDataFrame([(0, 1, 10), (0, 0, 12)], "route int, pos int, edge int"), lengths).collect()] == [240.0]


def test_terrain_data(spark):
    from loomgrid.functions import rings

    assert terrain.terrain_cells(spark, 0, 0, 8, 8, 4).select(F.sum(rings.area(F.col("ring")))).first()[0] == 64.0
    spans = spark.createDataFrame([(0.0,), (10.0,), (500.0,), (1e6,)], "s double").select(terrain.drape_depth(F.col("s")).alias("d"))
    assert [r.d for r in spans.collect()] == [2, 2, 4, 6]
    ring = rings.of((0, 0), (10, 0), (10, 10), (0, 10))
    low = terrain.anchors(spark.range(1).select("id", ring.alias("ring")), lambda x, z: -F.abs(x - 5.0) - F.abs(z - 5.0), ["id"]).first()
    assert low.high == 0.0 and low.low == -10.0
    flat = terrain.rail_height(lambda x, z: F.lit(3.0), True, 0.0, -10.0, 10.0)
    assert spark.range(1).select(flat).first()[0] == 15.0
    assert terrain.ground(lambda x, z: F.lit(10.0), lambda x, z: x)(F.lit(18.0), F.lit(0.0)) is not None
    from loomgrid.kernel.draws import random_seed

    assert random_seed() != random_seed()


def test_car_heights(spark):
    placed = spark.createDataFrame([(True, False), (False, True), (False, False)], "elevated boolean, below_grade boolean")
    got = network.car_heights(placed, F.lit(2.0), F.lit(9.0), 0.5, 1.0).collect()
    assert [(r.y, r.visible) for r in got] == [(10.0, True), (0.0, False), (2.5, True)]


def test_long_chains_fall_in_few_rounds(spark):
    from loomgrid.operators.network import spurs

    ring = [(k, k, (k + 1) % 5) for k in range(5)]  # stays
    chain = [(100 + k, 1000 + k, 1001 + k) for k in range(3000)] + [(99, 0, 1000)]  # hangs on the ring
    side = [(5000 + k, (1500, 6001, 6002, 6003)[k], 6001 + k) for k in range(4)]  # hangs on the chain
    loop = [(7000, 8000, 8000), (7001, 8000, 8001), (7002, 8001, 8002)]  # a loop with a tail: the tail falls
    rows = ring + chain + side + loop
    got = {r.edge for r in spurs(spark.createDataFrame(rows, "edge long, a long, b long"), most_rounds=12).collect()}
    left = list(rows)
    while True:
        degree = {}
        for _, a, b in left:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        keep = [x for x in left if degree[x[1]] > 1 and degree[x[2]] > 1]
        if len(keep) == len(left):
            break
        left = keep
    assert got == {e for e, _, _ in rows} - {e for e, _, _ in left} and len(got) > 3000


def test_far_points_find_their_line(spark):
    from loomgrid.operators.lines import nearest_lines

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3e5, 0.0), (3, None, 1.0)], "pid long, px double, pz double")
    lines = spark.createDataFrame([(7, 0.0, 5.0, 1.0, 5.0), (8, 0.0, 9.0, 1.0, 9.0)], "line long, ax double, az double, bx double, bz double")
    got = {r.pid: (r.line, round(r.d)) for r in nearest_lines(points, lines, 64.0).collect()}
    assert got == {1: (7, 5), 2: (7, 299999)}
    assert nearest_lines(points, lines.limit(0), 64.0).count() == 0
