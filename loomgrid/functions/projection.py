"""Local equirectangular projection and viewport predicates: x grows east, z grows south, in metres."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions import segments
from loomgrid.functions.scalars import finite, longitude_delta, wrap_longitude

# The earth's radius and the viewport.
RADIUS = 6378137.0
VIEWPORT = 900.0


def check_bounds(bounds: tuple[float, float, float, float] | float) -> tuple[float, float, float, float]:
    """(min_x, max_x, min_z, max_z) of a size or ordered bounds; TypeError and ValueError otherwise."""
    if isinstance(bounds, bool) or not isinstance(bounds, int | float | tuple | list):
        raise TypeError("bounds are a size or four numbers")
    if isinstance(bounds, int | float):
        if not (math.isfinite(bounds) and bounds > 0):
            raise ValueError("a size is positive and finite")
        half = bounds / 2
        return (-half, half, -half, half)
    if len(bounds) != 4 or not all(isinstance(v, int | float) for v in bounds):
        raise TypeError("bounds are four numbers")
    x0, x1, z0, z1 = map(float, bounds)
    if not all(map(math.isfinite, (x0, x1, z0, z1))) or x0 > x1 or z0 > z1:
        raise ValueError("bounds are finite and in order")
    return (x0, x1, z0, z1)


def in_view(x: Column, z: Column, bounds=VIEWPORT) -> Column:
    x0, x1, z0, z1 = check_bounds(bounds)
    return finite(x) & finite(z) & x.between(x0, x1) & z.between(z0, z1)


@dataclass(frozen=True)
class Projection:
    """Around an origin strictly between the poles."""

    lon: float
    lat: float
    metres_per_unit: float = 1.0
    bounds: tuple | float = VIEWPORT
    scale: float = field(init=False)

    def __post_init__(self):
        if not (math.isfinite(self.lon) and -180 <= self.lon <= 180):
            raise ValueError("longitude of the origin")
        if not (math.isfinite(self.lat) and -90 < self.lat < 90):
            raise ValueError("latitude of the origin")
        if not (math.isfinite(self.metres_per_unit) and self.metres_per_unit > 0):
            raise ValueError("metres_per_unit is positive")
        check_bounds(self.bounds)
        object.__setattr__(self, "scale", math.cos(math.radians(self.lat)))

    def forward(self, lon: Column, lat: Column) -> Column:
        """struct(x, z); null outside the range of longitudes and latitudes."""
        ok = finite(lon) & finite(lat) & lon.between(-180, 180) & lat.between(-90, 90)
        degree = math.pi / 180 * RADIUS / self.metres_per_unit
        x = longitude_delta(lon, self.lon) * F.lit(degree * self.scale) + 0.0
        z = -((lat - F.lit(float(self.lat))) * F.lit(degree)) + 0.0
        return F.when(ok, F.struct(x.alias("x"), z.alias("z")))

    def inverse(self, x: Column, z: Column) -> Column:
        """struct(lon, lat); null beyond the poles."""
        degree = math.pi / 180 * RADIUS / self.metres_per_unit
        lat = F.lit(float(self.lat)) - z / F.lit(degree)
        lon = wrap_longitude(F.lit(float(self.lon)) + x / F.lit(degree * self.scale))
        return F.when(finite(x) & finite(z) & lat.between(-90, 90), F.struct(lon.alias("lon"), lat.alias("lat")))

    def contains(self, x: Column, z: Column) -> Column:
        return in_view(x, z, self.bounds)

    def crop(self, points: Column) -> Column:
        """The points of an array<struct<x,z>> that are in view."""
        return F.filter(points, lambda p: self.contains(p["x"], p["z"]))

    def clip(self, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
        return segments.clip_closed(ax, az, bx, bz, *check_bounds(self.bounds))
