import math
import random

from loomgrid.operators.grid_join import nearest
from loomgrid.operators.lines import nearest_lines


def test_nearest_meets_few_of_many_sites(spark):
    """Before, each of 20,000 points met each of 20,000 sites."""
    rng = random.Random(5)
    spot = lambda: (rng.randrange(400) / 4.0, rng.randrange(400) / 4.0)
    sites = [(k, *spot()) for k in range(20_000)] + [(20_000, 500.0, 0.0)]
    points = [(k, *spot()) for k in range(20_000)] + [(20_000, 500.0, 160.0), (20_001, 900.0, 0.0)]
    found = {r.pid: (r.sid, r.d) for r in nearest(spark.createDataFrame(points, "pid long, px double, pz double"), spark.createDataFrame(sites, "sid long, sx double, sz double"), [], 200.0).collect()}
    assert set(found) == set(range(20_001)) and found[20_000] == (20_000, 160.0)
    for p, x, z in points[:150]:
        d, s = min((math.sqrt((x - sx) ** 2 + (z - sz) ** 2), s) for s, sx, sz in sites)
        assert found[p] == (s, d)


def test_lines_that_lie_in_each_other_are_met_by_the_longest(spark):
    """Two thousand lines from each of two corners: before, each of 2,000 points met nearly all of them."""
    lines = [(k, 0.0, 0.0, 1.0 + k / 4.0, 0.0) for k in range(2000)] + [(2000 + k, 0.0, 50.0, 0.0, 51.0 + k / 4.0) for k in range(2000)] + [(4000, 300.0, 9.0, 300.0, 9.0)]
    points = [(k, (k % 50) * 8.0 + 1.0, (k // 50) * 8.0 + 1.0) for k in range(2000)]
    found = {r.pid: (r.line, r.d) for r in nearest_lines(spark.createDataFrame(points, "pid long, px double, pz double"), spark.createDataFrame(lines, "line long, ax double, az double, bx double, bz double"), 64.0).collect()}

    def away(x, z, ax, az, bx, bz):
        ux, uz = bx - ax, bz - az
        t = max(0.0, min(1.0, ((x - ax) * ux + (z - az) * uz) / (ux * ux + uz * uz))) if (ax, az) != (bx, bz) else 0.0
        return math.sqrt((x - (ax + ux * t)) ** 2 + (z - (az + uz * t)) ** 2)

    for p, x, z in points[::97]:
        d, line = min((away(x, z, *ends), line) for line, *ends in lines)
        assert abs(found[p][1] - d) < 1e-9 and abs(away(x, z, *lines[found[p][0]][1:]) - d) < 1e-9
    assert len(found) == 2000


def test_clearances_by_sides(spark):
    from loomgrid.operators.land import clearances

    sides = [(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 0.0, 4.0), (1, 0.0, 4.0, 0.0, 0.0), (2, 10.0, 0.0, 10.0, 9.0)]
    points = [(1, 7.0, 0.0), (2, -6.0, 0.0), (3, -6.1, 0.0), (4, 1.0, 1.5)]
    found = clearances(spark.createDataFrame(points, "pid long, px double, pz double"), spark.createDataFrame(sides, "shape long, ax double, az double, bx double, bz double"), 6.0)
    assert sorted((r.pid, r.shape, r.d) for r in found.collect()) == [(1, 1, 3.0), (1, 2, 3.0), (2, 1, 6.0), (4, 1, 1.0)]
