import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.operators import polygons
from loomgrid.operators.cycles import gathered, trace
from loomgrid.operators.land import adjacent

RING = "array<struct<x:double,z:double>>"
DUMBBELL = [(0, 0), (24, 0), (24, 10), (40, 10), (40, 0), (64, 0), (64, 24), (40, 24), (40, 14), (24, 14), (24, 24), (0, 24)]


def ring(points):
    return [{"x": float(x), "z": float(z)} for x, z in points]


def area(points):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1])) / 2


def inside(x, z, points):
    return sum((p[1] > z) != (q[1] > z) and x < (q[0] - p[0]) * (z - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(points, points[1:] + points[:1])) % 2 == 1


def star(rng, n=14):
    """A simple ring around the origin with deep bays, counter-clockwise."""
    return [(r * math.cos(k / n * math.tau), r * math.sin(k / n * math.tau)) for k in range(n) for r in [rng.choice([4.0, 9.0, 20.0]) + rng.random()]]


def points(row):
    return [(p.x, p.z) for p in row]


def gap(x, z, p, q):
    vx, vz = q[0] - p[0], q[1] - p[1]
    t = max(0, min(1, ((x - p[0]) * vx + (z - p[1]) * vz) / (vx * vx + vz * vz)))
    return math.hypot(x - p[0] - vx * t, z - p[1] - vz * t)


def test_cycles_are_brute_force(spark):
    rng = random.Random(3)
    nodes = rng.sample(range(10_000), 700)
    shuffled, links = nodes[:], {}
    rng.shuffle(shuffled)
    at = 0
    for n in (1, 1, 2, 3, 7, 64, 65, 130, 427):
        part = shuffled[at : at + n]
        at += n
        links |= dict(zip(part, part[1:] + part[:1], strict=True))
    assert len(links) == 700
    traced = trace(spark.createDataFrame([(a, b, f"v{a}") for a, b in links.items()], "node long, next long, v string").repartition(5))
    got = {r.cycle: [i.v for i in r["items"]] for r in gathered(traced, [], F.col("v")).collect()}
    want, left = {}, set(links)
    while left:
        first = min(left)
        walk, n = [], first
        while not walk or n != first:
            walk.append(f"v{n}")
            left.remove(n)
            n = links[n]
        want[first] = walk
    assert got == want
    assert trace(spark.createDataFrame([], "node long, next long")).count() == 0


def test_pieces_in_a_half_plane(spark):
    rng = random.Random(11)
    shapes = [star(rng) for _ in range(60)]
    planes = [(math.cos(a), math.sin(a), rng.uniform(-12, 4)) for a in (rng.uniform(0, math.tau) for _ in shapes)]
    rows = [(n, ring(s if n % 2 else s[::-1]), *p) for n, (s, p) in enumerate(zip(shapes, planes, strict=True))]
    found = polygons.half_plane_pieces(spark.createDataFrame(rows, f"id long, ring {RING}, nx double, nz double, c double").repartition(3), "id")
    got = found.select("id", "ring", rings.is_simple(F.col("ring")).alias("simple")).collect()
    assert sum(sum(r.id == n for r in got) > 1 for n in range(60)) > 5
    for n, (shape, (nx, nz, c)) in enumerate(zip(shapes, planes, strict=True)):
        own = [points(r.ring) for r in got if r.id == n]
        clipped = []
        for p, q in zip(shape, shape[1:] + shape[:1]):
            fp, fq = nx * p[0] + nz * p[1] - c, nx * q[0] + nz * q[1] - c
            clipped += [p] if fp <= 0 else []
            clipped += [(p[0] + (q[0] - p[0]) * fp / (fp - fq), p[1] + (q[1] - p[1]) * fp / (fp - fq))] if (fp <= 0) != (fq <= 0) else []
        assert all(r.simple for r in got if r.id == n) and all(area(o) > 0 for o in own)
        assert math.isclose(sum(map(area, own)), area(clipped), abs_tol=1e-9)
        for _ in range(40):  # and the pieces hold just the points that the ring and the half-plane do
            x, z = rng.uniform(-20, 20), rng.uniform(-20, 20)
            assert sum(inside(x, z, o) for o in own) == (inside(x, z, shape) and nx * x + nz * z <= c)


def test_half_plane_edges(spark):
    rows = [(1, ring(DUMBBELL), 0.0, 1.0, 100.0), (2, ring(DUMBBELL), 0.0, 1.0, -1.0), (3, None, 0.0, 1.0, 0.0), (4, ring([(0, 0), (1, 1)]), 0.0, 1.0, 0.0), (5, ring(DUMBBELL), None, 1.0, 0.0), (6, ring(DUMBBELL), 0.0, 1.0, 9.0), (7, ring(DUMBBELL), 0.0, 1.0, 12.0)]
    got = polygons.half_plane_pieces(spark.createDataFrame(rows, f"id long, ring {RING}, nx double, nz double, c double"), "id").collect()
    assert sorted((r.id, round(area(points(r.ring)), 9)) for r in got) == [(1, 1216.0), (6, 216.0), (6, 216.0), (7, 608.0)]


def test_a_dumbbell_falls_apart(spark):
    rows = [(1, ring(DUMBBELL), [2.0] * 12), (2, ring(DUMBBELL[::-1]), [2.25] * 12), (3, ring(DUMBBELL), [1.0] * 12), (4, ring(DUMBBELL), [0.0] * 12), (5, ring(DUMBBELL), [13.0] * 12), (6, ring(DUMBBELL), [1.0]), (7, None, [1.0])]
    got = polygons.inset(spark.createDataFrame(rows, f"id long, ring {RING}, distances array<double>"), "id").collect()
    sizes = sorted((r.id, round(area(points(r.ring)), 9)) for r in got)
    assert sizes == [(1, 400.0), (1, 400.0), (2, 19.5**2), (2, 19.5**2), (3, 1004.0), (4, 1216.0)]


def test_insets_keep_their_distance(spark):
    rng = random.Random(2)
    shapes = [star(rng, 9) for _ in range(50)]
    far = [rng.choice([0.25, 0.75, 1.5]) for _ in shapes]
    rows = [(n, ring(s), [d] * len(s)) for n, (s, d) in enumerate(zip(shapes, far, strict=True))]
    got = polygons.inset(spark.createDataFrame(rows, f"id long, ring {RING}, distances array<double>").repartition(3), "id").collect()
    for n, (shape, d) in enumerate(zip(shapes, far, strict=True)):
        own = [points(r.ring) for r in got if r.id == n]
        edges = list(zip(shape, shape[1:] + shape[:1]))
        for _ in range(150):
            x, z = rng.uniform(-20, 20), rng.uniform(-20, 20)
            near = min(gap(x, z, *e) for e in edges)
            held = sum(inside(x, z, o) for o in own)
            assert held <= 1
            if held:
                assert inside(x, z, shape) and near >= d - 1e-6
            elif inside(x, z, shape) and near > d * 12:
                raise AssertionError((n, x, z))  # mitres reach further than d, but not so far


def test_mitred_offset(spark):
    square = ring([(0, 0), (10, 0), (10, 10), (0, 10)])
    told = spark.createDataFrame([(1, square, [1.0] * 4), (2, square, [1.0, 2.0, 3.0, 4.0]), (3, square, [5.0] * 4), (4, ring([(0, 0), (30, 0), (0, 3)]), [0.5] * 3)], f"id long, ring {RING}, d array<double>")
    got = {r.id: r.o and points(r.o) for r in told.select("id", rings.offset(F.col("ring"), F.col("d")).alias("o")).collect()}
    assert got[1] == [(1, 1), (9, 1), (9, 9), (1, 9)] and got[2] == [(4, 1), (8, 1), (8, 7), (4, 7)] and got[3] is None
    assert max(x for x, _ in got[4]) > 27.4  # the sharp corner is drawn back to 2.5 units from where it was
    assert all(math.hypot(x - 30, z) >= 2.5 - 1e-9 for x, z in got[4])


def test_walls_are_dissolved(spark):
    square = lambda x, z, w=2, d=2: [(x, z), (x + w, z), (x + w, z + d), (x, z + d)]
    rows = [(1, 1, square(0, 0)), (1, 2, square(2, 0)), (1, 3, square(0, 2, 3)), (1, 4, square(10, 10)), (1, 5, square(12, 12)), (2, 1, square(0, 0, 6)), (2, 2, square(0, 4, 6)), (2, 3, square(0, 2)), (2, 4, square(4, 2)[::-1]), (3, 1, square(0, 0)), (4, 1, [(0, 0), (1, 1)])]
    got = polygons.dissolve(spark.createDataFrame([(g, p, ring(r)) for g, p, r in rows], f"g long, p long, ring {RING}").repartition(3), "g", "p").collect()
    told = sorted((r.g, r.hole, round(area(points(r.ring)), 9), len(r.ring)) for r in got)
    assert told == [(1, False, 4.0, 4), (1, False, 4.0, 4), (1, False, 14.0, 6), (2, False, 36.0, 4), (2, True, -4.0, 4), (3, False, 4.0, 4)]


def test_cut_rings_dissolve_to_themselves(spark):
    rng = random.Random(5)
    shapes = [star(rng) for _ in range(25)]
    rows = [(n, ring(s), math.cos(n), math.sin(n), 1.0, -math.cos(n), -math.sin(n)) for n, s in enumerate(shapes)]
    told = spark.createDataFrame(rows, f"id long, ring {RING}, nx double, nz double, c double, mx double, mz double").withColumn("e", -F.col("c"))
    one = polygons.half_plane_pieces(told, "id")
    two = polygons.half_plane_pieces(told, "id", nx="mx", nz="mz", c="e")
    both = one.unionAll(two).withColumn("p", F.monotonically_increasing_id())
    got = polygons.dissolve(polygons.cut(both), "id", "p").collect()
    assert sorted(r.id for r in got) == list(range(25)) and not any(r.hole for r in got)
    assert all(math.isclose(area(points(r.ring)), area(shapes[r.id]), abs_tol=1e-3) for r in got)


def test_a_right_of_way_takes_its_part(spark):
    rows = [(1, ring(DUMBBELL), 30.0, -5.0, 4.0, 40.0), (2, ring(DUMBBELL), 100.0, 0.0, 1.0, 1.0), (3, ring([(0, 0), (9, 0), (9, 9), (0, 9)]), -1.0, -1.0, 20.0, 20.0)]
    got = polygons.trimmed(spark.createDataFrame(rows, f"id long, ring {RING}, x double, z double, w double, d double"), "id", ("x", "z", "w", "d")).collect()
    assert sorted((r.id, round(area(points(r.ring)), 9)) for r in got) == [(1, 576.0 + 4 * 4), (2, 1216.0)]


@pytest.mark.parametrize("cell", [3.0, 50.0])
def test_adjacent_parcels(spark, cell):
    rng = random.Random(7)
    boxes = [(p, n, rng.randrange(0, 12), rng.randrange(0, 12), rng.randrange(1, 5), rng.randrange(1, 5)) for p in range(3) for n in range(25)]
    rows = [(p, n, ring([(x, z), (x + w, z), (x + w, z + d), (x, z + d)])) for p, n, x, z, w, d in boxes]
    got = {(r.piece, r.a, r.b): round(r.shared, 6) for r in adjacent(spark.createDataFrame(rows, f"piece long, parcel long, ring {RING}"), cell=cell).collect()}

    def side(lo, hi, lo2, hi2):
        return max(0, min(hi, hi2) - max(lo, lo2))

    want = {}
    for p, a, x, z, w, d in boxes:
        for q, b, x2, z2, w2, d2 in boxes:
            if p == q and a < b:
                shared = sum(side(z, z + d, z2, z2 + d2) for u in (x, x + w) for v in (x2, x2 + w2) if u == v) + sum(side(x, x + w, x2, x2 + w2) for u in (z, z + d) for v in (z2, z2 + d2) if u == v)
                if shared:
                    want[p, a, b] = shared
    assert got == want


def test_clear_of_looks_at_copies_and_claims_in_claims_once(spark):
    """Two thousand claims from one corner and two thousand equal items: before, each met each, four million times."""
    from loomgrid.operators import land

    box = lambda x, z, w, d: [{"x": x, "z": z}, {"x": x + w, "z": z}, {"x": x + w, "z": z + d}, {"x": x, "z": z + d}]
    claims = [(k, box(0.0, 0.0, 1.0 + k % 50, 1.0 + k // 50)) for k in range(2000)] + [(2000, [{"x": 70.0, "z": 0.0}, {"x": 74.0, "z": 0.0}, {"x": 70.0, "z": 4.0}])]
    items = [(k, box(49.0, 39.0, 2.0, 2.0)) for k in range(2000)] + [(2000, box(50.0, 0.0, 2.0, 2.0)), (2001, box(73.0, 3.0, 2.0, 2.0)), (2002, box(71.0, 1.0, 1.0, 1.0))]
    told = lambda rows: spark.createDataFrame(rows, f"id long, ring {rings.RING}")
    assert sorted(r.id for r in land.clear_of(told(items), told(claims), "id", 16.0).collect()) == [2000, 2001]


def test_owners_by_box_and_ring(spark):
    from loomgrid.operators import land

    areas = spark.createDataFrame([(1, [{"x": 0.0, "z": 0.0}, {"x": 4.0, "z": 0.0}, {"x": 0.0, "z": 4.0}])], f"area long, ring {rings.RING}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 1.0), (4, -1.0, 1.0)], "pid long, px double, pz double")
    found = land.owners(points, areas, 16.0)
    assert [r.pid for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ">= bb" in plan  # the box decides before the ring is walked
