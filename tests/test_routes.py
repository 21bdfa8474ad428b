import heapq
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import network, terrain
from loomgrid.operators.lines import nearest_lines


def dijkstra(links, start):
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, n = heapq.heappop(heap)
        if c > cost[n]:
            continue
        for m, w in links.get(n, []):
            if c + w < cost.get(m, float("inf")) - 1e-12:
                cost[m] = c + w
                heapq.heappush(heap, (c + w, m))
    return cost


@pytest.fixture(scope="module")
def town():
    """Streets of a town of 30 x 30 corners, some missing, of three classes, and a part that no street leads to."""
    rng = random.Random(8)
    at = {n: (n % 30 * 10.0 + rng.random(), n // 30 * 10.0 + rng.random()) for n in range(900)} | {900: (0.0, 900.0), 901: (5.0, 900.0)}
    streets = [(900, 901, "local")]
    for n in range(900):
        for m in ([n + 1] if n % 30 < 29 else []) + ([n + 30] if n < 870 else []):
            if rng.random() < 0.85:
                streets.append((n, m, rng.choice(["arterial", "collector", "local", "boundary"])))
    return at, [(e, *s) for e, s in enumerate(streets)]


def test_paths_are_the_cheapest(spark, town):
    at, streets = town
    nodes = spark.createDataFrame([(n, x, z, 0.0) for n, (x, z) in at.items()], "node long, x double, z double, level double").repartition(4)
    edges = spark.createDataFrame(streets, "edge long, a long, b long, cls string").repartition(4)
    rng = random.Random(1)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(25)] + [(0, 901), (900, 901), (7, 7), (5, 12345), (0, 899), (0, 899)]
    speed = network.SPEEDS
    links, of = {}, {}
    for e, a, b, cls in streets:
        if cls != "boundary":
            w = ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5 / speed[cls]
            of[e] = (a, b, w)
            links.setdefault(a, []).append((b, w))
            links.setdefault(b, []).append((a, w))
    rows = network.shortest_paths(nodes, edges, spark.createDataFrame(pairs, "start long, goal long")).collect()
    ways = {}
    for r in sorted(rows, key=lambda r: r.pos):
        ways.setdefault((r.start, r.goal), []).append(r)
    for start, goal in set(pairs):
        want = dijkstra(links, start).get(goal) if goal in at else None
        way = ways.pop((start, goal), None)
        assert (way is None) == (want is None)
        if way:
            assert [r.pos for r in way] == list(range(len(way))) and (way[0].node, way[-1].node) == (start, goal) and way[0].edge is None
            assert abs(way[-1].cost - want) < 1e-9
            total = 0.0
            for before, r in zip(way, way[1:]):  # its edges lead from node to node, and their costs add up
                a, b, w = of[r.edge]
                assert {a, b} == {before.node, r.node}
                total += w
                assert abs(total - r.cost) < 1e-9
    assert not ways


def test_no_pairs_no_paths(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "node long, x double, z double")
    edges = spark.createDataFrame([], "edge long, a long, b long, cls string")
    none = spark.createDataFrame([], "start long, goal long")
    assert network.shortest_paths(nodes, edges, none).count() == 0
    alone = network.shortest_paths(nodes, edges, spark.createDataFrame([(1, 1)], "start long, goal long")).collect()
    assert [(r.node, r.pos, r.cost) for r in alone] == [(1, 0, 0.0)]


def test_nearest_line_of_points_without_a_place(spark):
    far, nan = float("inf"), float("nan")
    points = spark.createDataFrame([(1, 0.0, 3.0), (2, far, 0.0), (3, nan, 1.0), (4, None, 1.0), (5, 5000.0, -far), (6, 4000.0, 0.0)], "pid long, px double, pz double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 0.0, far, 0.0), (3, nan, 0.0, 1.0, 1.0)], "line long, ax double, az double, bx double, bz double")
    assert sorted((r.pid, r.line, r.d) for r in nearest_lines(points, lines, 8.0).collect()) == [(1, 1, 3.0), (6, 1, 3990.0)]


def decks(spark, spans, height, **more):
    b = spark.createDataFrame([(n, *map(float, s)) for n, s in enumerate(spans)], "bridge long, ax double, az double, bx double, bz double")
    told = terrain.run_decks(terrain.deck_heights(b, height, width=8.0, **more))
    return [r.deck for r in told.orderBy("bridge").collect()]


def test_spans_that_meet_share_their_deck(spark):
    bump = lambda x, z: F.when(F.abs(x + 10) < 6, 8.0).otherwise(0.0)
    left, right = decks(spark, [(-20, 0, 0, 0), (0, 0, 20, 0)], bump)
    assert left == right == 8 + terrain.DECK_CLEAR
    flat = lambda x, z: x * 0.0
    assert decks(spark, [(0, 0, 20, 0), (60, 0, 80, 0)], flat) == [terrain.DECK_LEAST] * 2
    beside = lambda x, z: F.when(z > 3.5, 5.0).otherwise(0.0)  # noqa: E731  (under the edge of the deck alone)
    assert decks(spark, [(0, 0, 20, 0)], beside) == [5 + terrain.DECK_CLEAR]


def test_decks_clear_the_banks(spark):
    water = lambda x, z: F.abs(x) - 10
    land = terrain.ground(lambda x, z: x * 0.0 + 24, water)
    straight, aslant = decks(spark, [(-10, 0, 10, 0), (-10, 100, 10, 135)], land, water=water)
    assert straight >= 24 + terrain.DECK_CLEAR - 1e-9 and aslant >= 24 + terrain.DECK_CLEAR - 1e-9
    narrow = lambda x, z: F.abs(x) - 1
    ridge = terrain.ground(lambda x, z: F.when(F.abs(z - 50) < 10, 24.0).otherwise(0.0), narrow)
    assert decks(spark, [(-1, 0, 1, 100)], ridge, water=narrow)[0] >= 24 + terrain.DECK_CLEAR - 1e-9


def test_ways_are_compared_to_the_last_digit(spark):
    """The direct way is found first and dearer by less than 1e-12; before, it stayed."""
    direct = 4000.0 + 2.0**-40
    steps = spark.createDataFrame([(1, 1, 3, direct), (1, 2, 2, 1500.0), (2, 3, 3, 2500.0)], "node long, edge long, next long, cost double")
    reached, _ = network.least_cost(steps, spark.createDataFrame([(1, 3)], "start long, goal long"))
    assert [(r.cost, r.before) for r in reached.where("node = 3").collect()] == [(4000.0, 2)]
