"""Scalar fields over the plane as Column expressions: terrain, water, population, street direction, exclusion.

A field is a Python function (x, z) -> Column that closes over a few parameters, which become literals of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions import rings
from loomgrid.functions.randoms import noise
from loomgrid.functions.scalars import finite, rbf_weight
from loomgrid.functions.segments import nearest_on

Field = Callable[[Column, Column], Column]
# Height of the terrain in metres, and the scales and shares of its two noises.
TOP = 72.0
MACRO_SCALE, DETAIL_SCALE = 3.75, 9.375
MACRO_SHARE, DETAIL_SHARE = 0.72, 0.28
DETAIL_SHIFT = (13.7, -8.2)
DIRECTION_SHIFT = (17.3, -4.1)
NO_SHORE = 1e9


def elevation(seed: str, size: float = 900.0) -> Field:
    """Metres in [0, TOP]; what isn't a number counts as 0."""
    wide, fine = size / MACRO_SCALE, size / DETAIL_SCALE

    def at(x: Column, z: Column) -> Column:
        px, pz = (F.when(finite(v), v).otherwise(0.0) for v in (x, z))
        n = noise(f"{seed}:elevation:macro", px / wide, pz / wide) * MACRO_SHARE + noise(f"{seed}:elevation:detail", px / fine + DETAIL_SHIFT[0], pz / fine + DETAIL_SHIFT[1]) * DETAIL_SHARE
        return F.greatest(F.lit(0.0), F.least(F.lit(TOP), (n + 1) * 0.5 * TOP))

    return at


def shores_of(land: dict, size: float = 900.0) -> list[tuple[list[tuple[float, float]], bool]]:
    """Shorelines (points, closed) of land kinds flat, river (x0, x1), coast (edge) and island (rx, rz)."""
    half = size / 2
    line = lambda x: ([(x, -half), (x, half)], False)
    kind = land.get("kind", "flat")
    if kind == "river":
        return [line(land["x0"]), line(land["x1"])]
    if kind == "coast":
        return [line(land["edge"])]
    if kind == "island":
        return [(rings.circle(land["rx"], land["rz"]), True)]
    return []


def is_land(land: dict) -> Field:
    kind = land.get("kind", "flat")
    if kind == "river":
        return lambda x, z: (x <= land["x0"]) | (x >= land["x1"])
    if kind == "coast":
        return lambda x, z: x >= land["edge"]
    if kind == "island":
        ring = rings.of(*rings.circle(land["rx"], land["rz"]))
        return lambda x, z: rings.contains(ring, x, z)
    return lambda x, z: F.lit(True)


def shore_segments(shores: Sequence[tuple[list, bool]]) -> list[tuple]:
    return [(p, q) for points, closed in shores for p, q in zip(points, points[1:] + points[:1] if closed else points[1:], strict=False)]


def water_distance(land: dict, size: float = 900.0) -> Field:
    """Distance to the nearest shore, negative on water; NO_SHORE where there is none. Banks and coasts go on beyond the viewport, as land does."""
    banks = [float(land[n]) for n in {"river": ("x0", "x1"), "coast": ("edge",)}.get(land.get("kind", "flat"), ())]
    if banks:
        on_land = is_land(land)

        def beside(x: Column, z: Column) -> Column:
            d = reduce(F.least, (F.abs(x - b) for b in banks))
            return F.when(on_land(x, z), d).otherwise(-d)

        return beside
    parts = shore_segments(shores_of(land, size))
    if not parts:
        return lambda x, z: F.lit(NO_SHORE)
    shore = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("ax", "az", "bx", "bz"), (*a, *b), strict=True))) for a, b in parts))
    dry = is_land(land)

    def at(x: Column, z: Column) -> Column:
        d = F.array_min(F.transform(shore, lambda s: nearest_on(x, z, s["ax"], s["az"], s["bx"], s["bz"])["d"]))
        return F.when(dry(x, z), d).otherwise(-d)

    return at


def imported_land(polygons: Column, x: Column, z: Column) -> Column:
    """Whether a point is outside all water polygons (array of polygons, each an outer ring and its holes)."""
    wet = F.exists(polygons, lambda p: rings.contains(F.element_at(p, 1), x, z) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda h: rings.contains(h, x, z)))
    return ~wet


def imported_water_distance(polygons: Column, x: Column, z: Column) -> Column:
    """Distance to the nearest ring of the polygons, negative inside the water."""
    all_rings = F.flatten(polygons)
    d = F.array_min(F.transform(all_rings, lambda r: rings.boundary_distance(r, x, z)))
    return F.when(d.isNull(), NO_SHORE).when(imported_land(polygons, x, z), d).otherwise(-d)


def population(centers: Sequence[dict], size: float = 900.0) -> Field:
    """Sum of Gaussian hills over its largest value on a 31 x 31 grid and at the centres; 1 at most."""

    def raw(x: float, z: float) -> float:
        return sum(c["w"] * math.exp(-((x - c["x"]) ** 2 + (z - c["z"]) ** 2) / (2 * c["sigma"] ** 2)) for c in centers)

    grid = [-size / 2 + k * size / 30 for k in range(31)]
    most = max([1e-6, *(raw(x, z) for x in grid for z in grid), *(raw(c["x"], c["z"]) for c in centers)])

    def at(x: Column, z: Column) -> Column:
        total = F.lit(0.0)
        for c in centers:
            dx, dz = x - F.lit(float(c["x"])), z - F.lit(float(c["z"]))
            total = total + F.lit(float(c["w"])) * F.exp(-(dx * dx + dz * dz) / F.lit(2.0 * c["sigma"] * c["sigma"]))
        return F.least(F.lit(1.0), total / F.lit(most))

    return at


def direction(sources: Sequence[dict], noise_seed: str | None = None, amplitude: float = 0.0, scale: float = 1 / 150, shores: Sequence[tuple[list, bool]] = (), shore_sigma: float = 120.0, shore_weight: float = 2.0, default: float = 0.0) -> Field:
    """Heading in [0, pi) of the streets: grid and radial sources and shore tangents, blended as lines without sense.

    A line of angle a is the vector (cos 2a, sin 2a), so opposite headings add up. Noise turns the blend, the less the nearer the shore."""
    tangents = [(a, b, math.atan2(b[1] - a[1], b[0] - a[0])) for a, b in shore_segments(shores) if a != b]

    def at(x: Column, z: Column) -> Column:
        px, pz = (F.when(finite(v), v).otherwise(0.0) for v in (x, z))
        cos2, sin2 = F.lit(0.0), F.lit(0.0)
        for s in sources:
            dx, dz = px - F.lit(float(s.get("x", 0.0))), pz - F.lit(float(s.get("z", 0.0)))
            w = F.lit(float(s.get("weight", 1.0))) * rbf_weight(dx * dx + dz * dz, float(s.get("sigma", math.inf)))
            w = F.greatest(w, F.lit(0.0))
            a = F.when((dx == 0) & (dz == 0), 0.0).otherwise(F.atan2(dz, dx)) if s.get("type") == "radial" else F.lit(float(s.get("angle", 0.0)))
            cos2, sin2 = cos2 + F.cos(2 * a) * w, sin2 + F.sin(2 * a) * w
        own = F.sqrt(cos2 * cos2 + sin2 * sin2)
        mass = F.lit(0.0)
        for a, b, angle in tangents:
            d = nearest_on(px, pz, *(F.lit(float(v)) for v in (*a, *b)))["d"]
            w = F.lit(shore_weight) * rbf_weight(d * d, shore_sigma)
            mass = mass + w
            cos2, sin2 = cos2 + F.lit(math.cos(2 * angle)) * w, sin2 + F.lit(math.sin(2 * angle)) * w
        angle = F.when(F.sqrt(cos2 * cos2 + sin2 * sin2) > 1e-12, F.atan2(sin2, cos2) / 2).otherwise(F.lit(float(default)))
        if noise_seed is not None and amplitude:
            n = noise(noise_seed, px * scale + DIRECTION_SHIFT[0], pz * scale + DIRECTION_SHIFT[1])
            whole = mass + own
            angle = angle + n * amplitude * (1 - F.least(F.lit(1.0), mass / F.when(whole != 0, whole).otherwise(1.0)))
        angle = F.pmod(angle, F.lit(math.pi))
        return F.when(angle >= math.pi, 0.0).otherwise(angle)

    return at


def exclusion(rects: Sequence[tuple[float, float, float, float]]) -> Field:
    """Whether a point is in any rectangle (x, z, w, d), boundary included."""

    def at(x: Column, z: Column) -> Column:
        hit = F.lit(False)
        for rx, rz, w, d in rects:
            hit = hit | (x.between(rx, rx + w) & z.between(rz, rz + d))
        return hit

    return at


def sample_grid(spark, fields: dict[str, Field], step: float = 24.0, size: float = 900.0):
    """One row per cell centre of a square raster, with the value of every field."""
    n = int(size // step)
    rows = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"))
    x, z = F.lit(-size / 2 + step / 2) + F.col("i") * step, F.lit(-size / 2 + step / 2) + F.col("j") * step
    placed = rows.select("i", "j", x.alias("x"), z.alias("z"))
    return placed.select("*", *(f(F.col("x"), F.col("z")).alias(name) for name, f in fields.items()))
