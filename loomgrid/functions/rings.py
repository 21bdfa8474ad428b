"""Ring geometry as Column expressions. A ring is array<struct<x:double,z:double>>, closed without repeating its first point."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions import segments
from loomgrid.functions.randoms import let
from loomgrid.functions.scalars import EPS

RING = "array<struct<x:double,z:double>>"


def point(x: Column | float, z: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(z).cast("double").alias("z"))


def of(*points: tuple) -> Column:
    return F.array(*(point(x, z) for x, z in points))


def rotated(ring: Column) -> Column:
    """The ring from its second point on."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    """array<struct<p, q>> of the ring's edges in order."""
    return F.zip_with(ring, rotated(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _fold(items: Column, value) -> Column:
    """Sum from left to right."""
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + value(e))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["z"] - e["q"]["x"] * e["p"]["z"]


def signed_area(ring: Column) -> Column:
    return _fold(edges(ring), _cross) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """struct(x, z); of a ring without area the mean of its points."""
    es = edges(ring)
    twice = _fold(es, _cross)
    cx, cz = (_fold(es, lambda e, c=c: (e["p"][c] + e["q"][c]) * _cross(e)) for c in "xz")
    n = F.size(ring)
    flat = F.abs(twice) < EPS
    third = F.when(~flat, 3 * twice)
    return point(F.when(flat, _fold(ring, lambda p: p["x"]) / n).otherwise(cx / third), F.when(flat, _fold(ring, lambda p: p["z"]) / n).otherwise(cz / third))


def bounds(ring: Column) -> Column:
    """struct(x, z, w, d)."""
    xs, zs = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["z"])
    x, z = F.array_min(xs), F.array_min(zs)
    return F.struct(x.alias("x"), z.alias("z"), (F.array_max(xs) - x).alias("w"), (F.array_max(zs) - z).alias("d"))


def rect(x: Column, z: Column, w: Column, d: Column) -> Column:
    return of((x, z), (x + w, z), (x + w, z + d), (x, z + d))


def ccw(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def contains(ring: Column, px: Column, pz: Column) -> Column:
    """Even-odd rule; points on the boundary may count either way."""
    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        above = (p["z"] > pz) != (q["z"] > pz)
        return above & (px < (p["x"] - q["x"]) * (pz - q["z"]) / F.when(p["z"] != q["z"], p["z"] - q["z"]) + q["x"])

    return F.aggregate(edges(ring), F.lit(0), lambda n, e: n + F.coalesce(crosses(e), F.lit(False)).cast("int")) % 2 == 1


def _touch(e: Column, f: Column) -> Column:
    return segments.touch(e["p"]["x"], e["p"]["z"], e["q"]["x"], e["q"]["z"], f["p"]["x"], f["p"]["z"], f["q"]["x"], f["q"]["z"])


def is_simple(ring: Column) -> Column:
    """Three points or more, no edge without length, and no two edges that aren't neighbours touch."""
    es = F.transform(edges(ring), lambda e, k: F.struct(e["p"].alias("p"), e["q"].alias("q"), k.alias("k")))
    n = F.size(ring)
    apart = lambda e, f: (f["k"] >= e["k"] + 2) & ~((e["k"] == 0) & (f["k"] == n - 1))
    empty = F.exists(es, lambda e: (e["p"]["x"] == e["q"]["x"]) & (e["p"]["z"] == e["q"]["z"]))
    meets = F.exists(es, lambda e: F.exists(es, lambda f: apart(e, f) & _touch(e, f)))
    return (n >= 3) & ~empty & ~meets


def boundary_distance(ring: Column, px: Column, pz: Column) -> Column:
    return F.array_min(F.transform(edges(ring), lambda e: segments.nearest_on(px, pz, e["p"]["x"], e["p"]["z"], e["q"]["x"], e["q"]["z"])["d"]))


def oriented_box(ring: Column) -> Column:
    """struct(cx, cz, w, d, angle) along the longest edge (the first of equals)."""
    longest = F.array_max(F.transform(edges(ring), lambda e, k: F.struct(((e["q"]["x"] - e["p"]["x"]) * (e["q"]["x"] - e["p"]["x"]) + (e["q"]["z"] - e["p"]["z"]) * (e["q"]["z"] - e["p"]["z"])).alias("l2"), (-k).alias("k"), F.atan2(e["q"]["z"] - e["p"]["z"], e["q"]["x"] - e["p"]["x"]).alias("angle"))))

    def along(turn: Column) -> Column:
        us, vs = (F.transform(ring, f) for f in (lambda p: p["x"] * turn["c"] + p["z"] * turn["s"], lambda p: p["z"] * turn["c"] - p["x"] * turn["s"]))
        ends = F.struct(F.array_min(us).alias("u0"), F.array_max(us).alias("u1"), F.array_min(vs).alias("v0"), F.array_max(vs).alias("v1"), turn.alias("turn"))
        return let(ends, placed)

    def placed(e: Column) -> Column:
        c, s, u, v = e["turn"]["c"], e["turn"]["s"], (e["u0"] + e["u1"]) / 2, (e["v0"] + e["v1"]) / 2
        return F.struct((u * c - v * s).alias("cx"), (u * s + v * c).alias("cz"), (e["u1"] - e["u0"]).alias("w"), (e["v1"] - e["v0"]).alias("d"), e["turn"]["angle"].alias("angle"))

    return let(let(longest["angle"], lambda a: F.struct(a.alias("angle"), F.cos(a).alias("c"), F.sin(a).alias("s"))), along)


def oriented_rect(cx: Column, cz: Column, w: Column, d: Column, angle: Column) -> Column:
    c, s = F.cos(angle), F.sin(angle)
    corner = lambda i, j: (cx + w * (i / 2) * c - d * (j / 2) * s, cz + w * (i / 2) * s + d * (j / 2) * c)
    return of(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def clip_half_plane(ring: Column, nx: float | Column, nz: float | Column, c: float | Column) -> Column:
    """The part with nx x + nz z <= c, as one ring."""
    nx, nz, c = (v if isinstance(v, Column) else F.lit(float(v)) for v in (nx, nz, c))
    side = lambda p: p["x"] * nx + p["z"] * nz - c

    def kept(e: Column) -> Column:
        a, b = side(e["p"]), side(e["q"])
        t = a / F.when(a != b, a - b)
        cut = point(e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * t, e["p"]["z"] + (e["q"]["z"] - e["p"]["z"]) * t)
        none = F.array().cast(RING)
        return F.concat(F.when(a <= 0, F.array(e["p"])).otherwise(none), F.when((a < 0) & (b > 0) | (a > 0) & (b < 0), F.array(cut)).otherwise(none))

    return F.flatten(F.transform(edges(ring), kept))


def shared_length(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """Length of boundary that two rings have in common."""
    one = lambda e, f: F.coalesce(segments.overlap(e["p"]["x"], e["p"]["z"], e["q"]["x"], e["q"]["z"], f["p"]["x"], f["p"]["z"], f["q"]["x"], f["q"]["z"], tol)["length"], F.lit(0.0))
    return _fold(edges(a), lambda e: _fold(edges(b), lambda f: one(e, f)))


def boxes_meet(ax, az, aw, ad, bx, bz, bw, bd, pad: float = 0.0) -> Column:
    """Whether two rectangles overlap by more than their boundary, the second one padded."""
    return (ax < bx + bw + pad) & (ax + aw > bx - pad) & (az < bz + bd + pad) & (az + ad > bz - pad)


def meets_rect(ring: Column, x: Column, z: Column, w: Column, d: Column) -> Column:
    """Whether a ring and an axis-aligned rectangle overlap."""
    b = bounds(ring)
    corners = rect(x, z, w, d)
    within = F.exists(ring, lambda p: (p["x"] > x) & (p["x"] < x + w) & (p["z"] > z) & (p["z"] < z + d))
    around = F.exists(corners, lambda p: contains(ring, p["x"], p["z"]))
    return boxes_meet(b["x"], b["z"], b["w"], b["d"], x, z, w, d) & (within | around | _edges_cross(ring, corners))


def _edges_cross(a: Column, b: Column) -> Column:
    hit = lambda e, f: segments.intersect(e["p"]["x"], e["p"]["z"], e["q"]["x"], e["q"]["z"], f["p"]["x"], f["p"]["z"], f["q"]["x"], f["q"]["z"]).isNotNull()
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: hit(e, f)))


def meet(a: Column, b: Column) -> Column:
    """Whether two rings overlap: boxes first, then edges, then one holding the other."""
    p, q = bounds(a), bounds(b)
    first = lambda r: F.element_at(r, 1)
    boxes = boxes_meet(p["x"], p["z"], p["w"], p["d"], q["x"], q["z"], q["w"], q["d"])
    return boxes & (_edges_cross(a, b) | contains(b, first(a)["x"], first(a)["z"]) | contains(a, first(b)["x"], first(b)["z"]))


def circle(rx: float, rz: float, n: int = 56) -> list[tuple[float, float]]:
    return [(math.cos(k / n * math.tau) * rx, math.sin(k / n * math.tau) * rz) for k in range(n)]


def close_to(p: Column, q: Column, eps: float) -> Column:
    return (F.abs(p["x"] - q["x"]) < eps) & (F.abs(p["z"] - q["z"]) < eps)


def _with_neighbours(ring: Column) -> Column:
    """array<struct<before, p, after>>."""
    last = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    pairs = F.zip_with(last, ring, lambda b, p: F.struct(b.alias("before"), p.alias("p")))
    return F.zip_with(pairs, rotated(ring), lambda s, q: F.struct(s["before"].alias("before"), s["p"].alias("p"), q.alias("after")))


def tidy(ring: Column, eps: float = 1e-6) -> Column:
    """Without the points that repeat the one before."""
    return let(ring, lambda r: F.when(F.size(r) > 1, F.transform(F.filter(_with_neighbours(r), lambda s: ~close_to(s["before"], s["p"], eps)), lambda s: s["p"])).otherwise(r))


def straightened(ring: Column, tol: float = 1e-6) -> Column:
    """Without repeated points and those on the straight line between their neighbours."""
    def bends(s: Column) -> Column:
        ax, az = s["p"]["x"] - s["before"]["x"], s["p"]["z"] - s["before"]["z"]
        bx, bz = s["after"]["x"] - s["p"]["x"], s["after"]["z"] - s["p"]["z"]
        return F.abs(ax * bz - az * bx) > tol * (F.sqrt(ax * ax + az * az) + F.sqrt(bx * bx + bz * bz))

    return let(tidy(ring, tol), lambda r: F.transform(F.filter(_with_neighbours(r), bends), lambda s: s["p"]))


def is_convex(ring: Column, tol: float = 1e-9) -> Column:
    """Whether a counter-clockwise ring never turns right, and turns once around."""
    def turn(s: Column) -> Column:
        ax, az = s["p"]["x"] - s["before"]["x"], s["p"]["z"] - s["before"]["z"]
        bx, bz = s["after"]["x"] - s["p"]["x"], s["after"]["z"] - s["p"]["z"]
        return F.struct((ax * bz - az * bx).alias("cross"), (ax * bx + az * bz).alias("dot"))

    turns = F.transform(_with_neighbours(ring), turn)
    around = F.aggregate(turns, F.lit(0.0), lambda s, t: s + F.atan2(t["cross"], t["dot"]))
    return F.forall(turns, lambda t: t["cross"] >= -tol) & (around < 2 * math.pi + 0.1)


def moved_lines(ring: Column, distances: Column) -> Column:
    """array<struct<p, dx, dz, d>>: the lines of a counter-clockwise ring's edges, moved inwards by their distances; p is where the
    edge's first point comes to lie."""
    def line(e: Column, d: Column) -> Column:
        ex, ez = e["q"]["x"] - e["p"]["x"], e["q"]["z"] - e["p"]["z"]
        length = F.sqrt(ex * ex + ez * ez)
        return F.struct(point(e["p"]["x"] - ez / length * d, e["p"]["z"] + ex / length * d).alias("p"), (ex / length).alias("dx"), (ez / length).alias("dz"), d.alias("d"))

    return F.zip_with(edges(ring), distances, line)


def corners(lines: Column) -> Column:
    """The points in which each line meets the one before it; on parallel lines the line's own."""
    before = F.concat(F.slice(lines, -1, 1), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))

    def meet_at(a: Column, b: Column) -> Column:
        den = a["dx"] * b["dz"] - a["dz"] * b["dx"]
        flat = F.abs(den) < 1e-9
        t = ((b["p"]["x"] - a["p"]["x"]) * b["dz"] - (b["p"]["z"] - a["p"]["z"]) * b["dx"]) / F.when(~flat, den)
        return F.when(flat, b["p"]).otherwise(point(a["p"]["x"] + a["dx"] * t, a["p"]["z"] + a["dz"] * t))

    return F.zip_with(before, lines, meet_at)


def offset(ring: Column, distances: Column, miter_limit: float = 3.0) -> Column:
    """A counter-clockwise ring with its edges moved inwards, each by its own distance; corners that come to lie further off than the
    limit are drawn back towards where they were. Null where nothing is left, or what is left crosses itself."""
    lines = moved_lines(ring, distances)
    before = F.concat(F.slice(distances, -1, 1), F.slice(distances, 1, F.greatest(F.size(distances) - 1, F.lit(0))))
    limits = F.zip_with(distances, before, lambda d, b: F.greatest(d, b) * miter_limit + 1)

    def drawn_back(s: Column, limit: Column) -> Column:
        dx, dz = s["to"]["x"] - s["p"]["x"], s["to"]["z"] - s["p"]["z"]
        far = F.sqrt(dx * dx + dz * dz)
        k = F.when(far > limit, limit / far).otherwise(1.0)
        return point(s["p"]["x"] + dx * k, s["p"]["z"] + dz * k)

    moved = let(lines, corners)
    made = let(F.zip_with(F.zip_with(ring, moved, lambda p, to: F.struct(p.alias("p"), to.alias("to"))), limits, drawn_back), tidy)
    return let(made, lambda m: F.when((F.size(ring) >= 3) & (F.size(m) >= 3) & (signed_area(m) > 0) & is_simple(m), m))
