"""Scalar arithmetic on coordinates and angles, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coordinate grid, the orientation tolerance and the clearances of a lane.
QUANTUM = 0.25
EPS = 1e-9
LANE_CLEARANCE, BRIDGE_CLEARANCE = 1.9, 3.4
TURN = 2 * math.pi


def quantize(v: Column, quantum: float = QUANTUM) -> Column:
    """Nearest multiple of quantum, halves upwards (round() would go away from zero); never -0.0."""
    return F.floor(v / F.lit(float(quantum)) + 0.5) * F.lit(float(quantum)) + 0.0


def quantize_within(v: Column, low: float, high: float, quantum: float = QUANTUM) -> Column:
    """quantize(), kept on the grid points inside the bounds."""
    least, most = math.ceil(low / quantum) * quantum, math.floor(high / quantum) * quantum
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), quantize(v, quantum))) + 0.0


def orient(ax: Column, az: Column, bx: Column, bz: Column, cx: Column, cz: Column) -> Column:
    """1 for a left turn a b c, -1 for a right one, 0 within the tolerance."""
    cross = (bx - ax) * (cz - az) - (bz - az) * (cx - ax)
    return F.when(cross > EPS, 1).when(cross < -EPS, -1).otherwise(0)


def distance(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az))


def angle_diff(a: Column, b: Column) -> Column:
    """a - b on the circle, in (-pi, pi]."""
    d = (a - b) % F.lit(TURN)
    return F.when(d > math.pi, d - TURN).when(d <= -math.pi, d + TURN).otherwise(d)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(angle_diff(a, b))


def nearest_aligned(major: Column, heading: Column) -> Column:
    """Of the four headings at right angles to major, the one closest to heading; the first of equals."""
    options = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.abs(angle_diff(major + k * (math.pi / 2), heading)).alias("d"), k.alias("k")))
    return major + F.array_min(options)["k"] * (math.pi / 2)


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180]; +180 stays +180."""
    w = F.pmod(F.pmod(lon + 180.0, F.lit(360.0)), F.lit(360.0)) - 180.0
    return F.when((w == -180.0) & (lon > 0), F.lit(180.0)).otherwise(w)


def longitude_delta(lon: Column, origin: float) -> Column:
    return wrap_longitude(lon - F.lit(float(origin)))


def right_lane_offset(width: Column, bridge: Column) -> Column:
    """How far right of the axis a car drives, clear of the edge or the parapet."""
    clear = F.when(F.coalesce(bridge, F.lit(False)), BRIDGE_CLEARANCE).otherwise(LANE_CLEARANCE)
    return F.greatest(F.lit(0.0), F.least(width / 4, width / 2 - clear))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def rbf_weight(d2: Column, sigma: float) -> Column:
    """Gaussian falloff of a squared distance; an infinite sigma weighs 1 everywhere."""
    if math.isinf(sigma):
        return F.when(finite(d2) & (d2 >= 0), 1.0).otherwise(0.0)
    if sigma <= 0:
        return F.when(d2 == 0, 1.0).otherwise(0.0)
    return F.when(~finite(d2) | (d2 < 0), 0.0).when(d2 == 0, 1.0).otherwise(F.exp(-d2 / F.lit(float(sigma) ** 2)))
