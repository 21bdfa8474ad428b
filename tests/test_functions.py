import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import fields, randoms, rings, scalars, segments
from loomgrid.functions.exact import clip_exactly, exact_clip
from loomgrid.functions.projection import Projection, check_bounds
from loomgrid.kernel import plane
from loomgrid.kernel.draws import Stream, value_noise


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_hash_and_stream(spark):
    texts = ["abc:city", "", "ß😀", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", randoms.hash_text(F.col("t")).alias("h"), randoms.draws(randoms.stream(F.col("t"), "life"), 5).alias("u")).collect()
    assert {r.t: r.h for r in rows} == {t: randoms.hash_value(t) for t in texts}
    assert randoms.hash_value("abc:city") == 3385994236
    for r in rows:
        s = Stream(f"{r.t}:life")
        assert r.u == [s.next() for _ in range(5)]


def test_noise_is_the_kernels(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(200)] + [(-0.0, 0.0), (-3.0, 7.0)]
    at = value_noise("s:noise")
    got = spark.createDataFrame(pts, "x double, z double").select("x", "z", randoms.noise("s:noise", F.col("x"), F.col("z")).alias("n")).collect()
    assert all(math.isclose(r.n, at(r.x, r.z), abs_tol=1e-12) for r in got)


def test_quantize_rounds_up(spark):
    r = one(spark, a=scalars.quantize(F.lit(-0.125)), b=scalars.quantize(F.lit(0.125)), c=scalars.quantize(F.lit(-2.5), 1.0), d=scalars.quantize_within(F.lit(450.3), -450.1, 450.1))
    assert (r.a, r.b, r.c, r.d) == (0.0, 0.25, -2.0, 450.0)
    assert math.copysign(1, r.a) == 1


def test_angles(spark):
    rng = random.Random(2)
    pairs = [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(100)] + [(math.pi, 0.0), (-math.pi, 0.0)]
    got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", scalars.angle_diff(F.col("a"), F.col("b")).alias("d"), scalars.nearest_aligned(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert -math.pi < r.d <= math.pi and math.isclose(math.cos(r.d), math.cos(r.a - r.b), abs_tol=1e-9)
        assert abs(plane.turn(r.n, r.b)) <= math.pi / 4 + 1e-9


def _segments(n=300, seed=3):
    rng = random.Random(seed)
    return [tuple(rng.randint(-8, 8) / 2 for _ in range(8)) for _ in range(n)]


NAMES = ["ax", "az", "bx", "bz", "cx", "cz", "dx", "dz"]


def test_crossings(spark):
    df = spark.createDataFrame(_segments(), ", ".join(f"{n} double" for n in NAMES))
    cols = [F.col(n) for n in NAMES]
    for r in df.select("*", segments.intersect(*cols).alias("k"), segments.nearest_on(*cols[:6]).alias("n")).collect():
        hit = plane.cross_at((r.ax, r.az), (r.bx, r.bz), (r.cx, r.cz), (r.dx, r.dz))
        assert (r.k is None) == (hit is None)
        if hit:
            assert math.isclose(r.k.t, hit[0]) and math.isclose(r.k.u, hit[1], abs_tol=1e-12)
        d, t = plane.foot((r.ax, r.az), (r.bx, r.bz), (r.cx, r.cz))
        assert math.isclose(r.n.d, d, abs_tol=1e-12) and math.isclose(r.n.t, t, abs_tol=1e-12)


def test_touch(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    cases = {(0, 0, 2, 0, 2, 0, 4, 1): False, (0, 0, 2, 0, 1, 0, 1, 3): True, (0, 0, 2, 0, 0, 0, 2, 0): True, (0, 0, 2, 0, 2, 0, 1, 0): True, (0, 0, 2, 0, 2, 0, 3, 0): False, (0, 0, 2, 2, 0, 2, 2, 0): True, (0, 0, 1, 0, 0, 1, 1, 1): False}
    for c, expected in cases.items():
        assert one(spark, t=segments.touch(*lit(*c))).t is expected, c


def test_clipping(spark):
    df = spark.createDataFrame(_segments(400, 5), ", ".join(f"{n} double" for n in NAMES))
    cols = [F.col(n) for n in NAMES[:4]]
    b = (-2.0, 2.0, -1.0, 3.0)
    for r in df.select("*", segments.clip_open(*cols, *b).alias("o"), segments.clip_closed(*cols, *b).alias("c"), clip_exactly(*cols, b).alias("e")).collect():
        exact = exact_clip(r.ax, r.az, r.bx, r.bz, *b)
        assert (r.e.ax is None) == (exact is None) == (r.c is None)
        if exact:
            assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(r.c, exact))
            assert tuple(r.e) == exact
        longer = exact is not None and exact[:2] != exact[2:]
        assert (r.o is not None) == longer


def test_rings(spark):
    rng = random.Random(4)
    made = []
    for _ in range(60):
        n = rng.randint(3, 9)
        angles = sorted(rng.uniform(0, math.tau) for _ in range(n))
        made.append([(rng.uniform(2, 9) * math.cos(a), rng.uniform(2, 9) * math.sin(a)) for a in angles])
    df = spark.createDataFrame([(k, [{"x": x, "z": z} for x, z in r]) for k, r in enumerate(made)], f"k int, ring {rings.RING}")
    r = F.col("ring")
    p = (F.lit(0.5), F.lit(-0.25))
    got = df.select("k", rings.signed_area(r).alias("a"), rings.centroid(r).alias("c"), rings.bounds(r).alias("b"), rings.contains(r, *p).alias("i"), rings.boundary_distance(r, *p).alias("d"), rings.oriented_box(r).alias("o"), rings.is_simple(r).alias("s"), rings.area(rings.clip_half_plane(rings.ccw(r), 1.0, 0.5, 0.3)).alias("h")).collect()
    for row in got:
        ring = made[row.k]
        assert math.isclose(row.a, plane.area(ring), abs_tol=1e-9)
        assert math.isclose(row.c.x, plane.centre(ring)[0], abs_tol=1e-6)
        assert math.isclose(row.b.w, max(x for x, _ in ring) - min(x for x, _ in ring))
        assert row.i == plane.inside((0.5, -0.25), ring)
        assert math.isclose(row.d, plane.outer_distance((0.5, -0.25), ring), abs_tol=1e-9)
        assert math.isclose(row.o.w, plane.box(ring)[2], abs_tol=1e-9)
    square, bow = rings.of((0, 0), (2, 0), (2, 2), (0, 2)), rings.of((0, 0), (2, 2), (2, 0), (0, 2))
    r = one(spark, s=rings.is_simple(square), b=rings.is_simple(bow), f=rings.area(rings.clip_half_plane(square, 1.0, 0.0, 0.5)), l=rings.shared_length(square, rings.of((2, 1), (5, 1), (5, 9), (2, 9))), m=rings.meet(square, rings.of((1, 1), (5, 1), (5, 5))), n=rings.meet(square, rings.of((3, 3), (5, 3), (5, 5))), q=rings.meets_rect(square, F.lit(1.0), F.lit(1.0), F.lit(9.0), F.lit(9.0)))
    assert (r.s, r.b, r.f, r.l, r.m, r.n, r.q) == (True, False, 1.0, 1.0, True, False, True)


def test_projection(spark):
    p = Projection(13.4, 52.5)
    m = p.forward(F.lit(13.41), F.lit(52.51))
    r = one(spark, m=m, back=p.inverse(m["x"], m["z"]), far=p.forward(F.lit(200.0), F.lit(0.0)), origin=p.forward(F.lit(13.4), F.lit(52.5)), wrap=scalars.wrap_longitude(F.lit(190.0)), tie=scalars.wrap_longitude(F.lit(180.0)))
    assert r.m.x > 0 > r.m.z and math.isclose(r.back.lon, 13.41) and math.isclose(r.back.lat, 52.51)
    assert r.far is None and tuple(r.origin) == (0.0, 0.0) and r.wrap == -170.0 and r.tie == 180.0
    for bad in ((0, 90), (181, 0), (0, math.nan)):
        with pytest.raises(ValueError):
            Projection(*bad)
    with pytest.raises(TypeError):
        check_bounds("900")
    with pytest.raises(ValueError):
        check_bounds((1, 0, 0, 1))
    assert check_bounds(900) == (-450, 450, -450, 450)


def test_fields(spark):
    pond = F.array(F.array(rings.of((0, 0), (10, 0), (10, 10), (0, 10)), rings.of((4, 4), (6, 4), (6, 6), (4, 6))))
    r = one(spark, a=fields.imported_water_distance(pond, F.lit(1.0), F.lit(5.0)), b=fields.imported_water_distance(pond, F.lit(5.0), F.lit(5.0)), c=fields.imported_water_distance(pond, F.lit(-3.0), F.lit(5.0)), n=fields.elevation("s")(F.lit(float("nan")), F.lit(0.0)), z=fields.elevation("s")(F.lit(0.0), F.lit(0.0)), e=fields.exclusion([(0, 0, 1, 1)])(F.lit(1.0), F.lit(1.0)), s=fields.water_distance({"kind": "flat"})(F.lit(1.0), F.lit(1.0)), i=fields.water_distance({"kind": "island", "rx": 387.0, "rz": 342.0})(F.lit(0.0), F.lit(0.0)))
    assert (r.a, r.b, r.c) == (-1.0, 1.0, 3.0) and r.n == r.z and r.e and r.s == 1e9 and 330 < r.i < 343
    heading = fields.direction([{"type": "grid", "angle": 0.3}], shores=[([(-100.0, 0.0), (100.0, 0.0)], False)], shore_weight=50.0)
    near, far = one(spark, near=heading(F.lit(0.0), F.lit(1.0)), far=heading(F.lit(0.0), F.lit(5000.0)))
    assert min(near, math.pi - near) < 0.02 and math.isclose(far, 0.3)


def test_banks_go_on_beyond_the_viewport(spark):
    river, coast = fields.water_distance({"kind": "river", "x0": -60.0, "x1": 35.5}), fields.water_distance({"kind": "coast", "edge": 120.0})
    r = one(spark, a=river(F.lit(-59.0), F.lit(500.0)), b=river(F.lit(40.0), F.lit(-600.0)), c=coast(F.lit(100.0), F.lit(470.0)))
    assert (r.a, r.b, r.c) == (-1.0, 4.5, -20.0)
