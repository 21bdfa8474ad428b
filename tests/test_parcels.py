import itertools
import math
import random

from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators import checks, parcels
from loomgrid.operators.lines import without_spans
from tests.test_polygons import RING, area, points, ring, star


def square(x, z, w=4, d=4):
    return [(x, z), (x + w, z), (x + w, z + d), (x, z + d)]


def test_parcels_tile_their_ring(spark):
    rng = random.Random(6)
    shapes = [star(rng, 12) for _ in range(12)] + [square(0, 0, 30, 10), square(0, 0, 2, 2)]
    blocks = spark.createDataFrame([(n, ring(s if n % 2 else s[::-1])) for n, s in enumerate(shapes)] + [(99, None)], f"id long, ring {RING}").repartition(3)
    told = parcels.subdivide(blocks, "id", 20.0, 1.5, least_area=0.0)
    found = told.withColumn("box", rings.oriented_box(F.col("ring"))).collect()
    assert len({(r.id, r.path) for r in found}) == len(found) and {r.id for r in found} == set(range(14))
    for n, shape in enumerate(shapes):
        own = [r for r in found if r.id == n]
        assert math.isclose(sum(area(points(r.ring)) for r in own), area(shape), rel_tol=1e-9)
        assert all(area(points(r.ring)) < 20 or min(r.box.w, r.box.d) < 3 for r in own)
        assert all(r.sliver == (area(points(r.ring)) < 1.5 * 1.5 * 0.8 or min(r.box.w, r.box.d) < 1.5 * 0.7) for r in own)
    again = {(r.id, r.path): r.ring for r in parcels.subdivide(blocks.repartition(7), "id", 20.0, 1.5, least_area=0.0).collect()}
    assert again == {(r.id, r.path): r.ring for r in found}
    other = parcels.subdivide(blocks, "id", 20.0, 1.5, seed="other", least_area=0.0).collect()
    assert {(r.id, r.path) for r in other} != set() and any(again.get((r.id, r.path)) != r.ring for r in other)


def test_landlocked_parcels_find_a_neighbour(spark):
    rng = random.Random(4)
    cells = [(p, x, z) for p in range(6) for x in range(6) for z in range(6) if rng.random() < 0.7]
    rows = [(p, n, ring(square(x * 4, z * 4)), rng.random() < 0.15 or None) for n, (p, x, z) in enumerate(cells)]
    got = parcels.merge_landlocked(spark.createDataFrame(rows, f"g long, p long, ring {RING}, frontage boolean").repartition(4), "g", "p").collect()
    beside = {n: [m for m, c in enumerate(cells) if c[0] == cells[n][0] and abs(c[1] - cells[n][1]) + abs(c[2] - cells[n][2]) == 1] for n in range(len(cells))}
    left, fronts, shut = set(range(len(cells))), 0, 0
    while left:
        comp, queue = set(), [min(left)]
        while queue:
            n = queue.pop()
            if n not in comp:
                comp.add(n)
                queue += beside[n]
        left -= comp
        own = sum(bool(rows[n][3]) for n in comp)
        fronts += own
        shut += 0 if own else len(comp)
    assert (sum(r.frontage for r in got), sum(not r.frontage for r in got)) == (fronts, shut)
    assert sum(r.members for r in got) == len(cells)
    for r in got:
        assert math.isclose(area(points(r.ring)) + sum(area(points(h)) for h in r.holes), 16 * r.members)  # holes run clockwise


def test_an_enclosed_parcel_stays_or_fills(spark):
    left = [(0, 0), (3, 0), (3, 2), (2, 2), (2, 4), (3, 4), (3, 6), (0, 6)]
    right = [(3, 0), (6, 0), (6, 6), (3, 6), (3, 4), (4, 4), (4, 2), (3, 2)]
    rows = [(1, 1, ring(left), True), (1, 2, ring(right), False), (1, 3, ring(square(2, 2, 2, 2)), True)]
    got = {r.p: r for r in parcels.merge_landlocked(spark.createDataFrame(rows, f"g long, p long, ring {RING}, frontage boolean"), "g", "p").collect()}
    assert set(got) == {1, 3} or set(got) == {1, 2}
    assert sum(area(points(r.ring)) + sum(area(points(h)) for h in r.holes) for r in got.values()) == 36
    none = parcels.merge_landlocked(spark.createDataFrame([], f"g long, p long, ring {RING}, frontage boolean"), "g", "p")
    assert none.count() == 0


def test_what_spans_leave(spark):
    rng = random.Random(2)
    extents = [(k, float(rng.randrange(0, 5)), float(rng.randrange(5, 40))) for k in range(40)] + [(90, 3.0, 3.0), (91, None, 4.0)]
    spans = [(rng.randrange(42), a, a + rng.choice([-2.0, 0.0, 1.0, 3.0, 9.0])) for a in (float(rng.randrange(-5, 45)) for _ in range(150))] + [(1, None, 2.0)]
    schema = "k long, start double, stop double"
    got = without_spans(spark.createDataFrame(extents, schema), spark.createDataFrame(spans, schema).repartition(3), ["k"]).collect()
    for k, low, high in extents:
        own = sorted((r.nth, r.start, r.stop) for r in got if r.k == k)
        if low is None or low >= high:
            assert not own
            continue
        units = [u for u in range(int(low), int(high)) if not any(j == k and a is not None and a <= u and u + 1 <= b for j, a, b in spans)]
        runs = [list(g) for _, g in itertools.groupby(units, key=lambda u, c=itertools.count(): u - next(c))]
        assert own == [(n, float(g[0]), float(g[-1] + 1)) for n, g in enumerate(runs)]


def test_signature_has_no_order(spark):
    rows = [(n, None if n % 5 == 0 else f"t{n}", [{"a": n, "b": None}] * (n % 3)) for n in range(60)]
    schema = "id long, text string, items array<struct<a:long,b:string>>"
    sign = lambda data, parts: checks.signature(spark.createDataFrame(data, schema).repartition(parts)).first()
    base = sign(rows, 1)
    assert sign(rows[::-1], 7) == base and base["rows"] == 60
    for other in (rows[1:], rows + rows[:1], [(0, "", [])] + rows[1:], [(0, None, [{"a": 0, "b": None}])] + rows[1:], [*rows[:-1], (59, "t59", [{"a": 59, "b": ""}] * 2)]):
        assert sign(other, 2).signature != base.signature
    assert checks.signature(spark.createDataFrame([], schema)).first() == (0, "0")


def test_rising_ids(spark):
    rows = [("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("a", 4, 2), ("b", 1, 1), ("b", 2, None), ("b", 3, 0)]
    got = checks.not_rising(spark.createDataFrame(rows, "k string, at int, id long"), ["k"], ["at"], "id").collect()
    assert sorted((r.k, r["at"], r.id, r.before) for r in got) == [("a", 3, 7, 7), ("a", 4, 2, 7)]


def test_points_leave_the_water(spark):
    rng = random.Random(5)
    rows = [(n, rng.uniform(-50, 50), rng.uniform(-50, 50)) for n in range(80)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "pid long, px double, pz double").repartition(3)
    got = {r.pid: (r.x, r.z) for r in checks.on_land(df, lambda x, z: x - 10, 100.0, 11).collect()}
    grid = [(x, z) for x in range(-50, 51, 10) for z in range(-50, 51, 10) if x > 10]
    for n, x, z in rows[:-1]:
        if x > 10:
            assert got[n] == (x, z)
        else:
            assert math.isclose(min(math.dist(g, (x, z)) for g in grid), math.dist(got[n], (x, z))) and (round(got[n][0]), round(got[n][1])) in grid
    assert got[900] == (None, 1.0)
    dry = checks.on_land(df, lambda x, z: x * 0 - 1, 100.0, 11).collect()
    assert {(r.pid, r.x, r.z) for r in dry} == set(rows)
