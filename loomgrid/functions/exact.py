"""Clipping with exact rational arithmetic, correctly rounded once, where doubles won't do: an Arrow UDF."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_cut(a: float, b: float, c: float, d: float, bound: float) -> float:
    """Second coordinate of the line through (a, c) and (b, d) where the first is bound."""
    a, b, c, d, at = map(Fraction, (a, b, c, d, bound))
    return float(c + (d - c) * (at - a) / (b - a))


def exact_clip(ax: float, az: float, bx: float, bz: float, x0: float, x1: float, z0: float, z1: float) -> tuple | None:
    """Inclusive clipping; a touch gives a segment of two equal points."""
    p = [Fraction(v) for v in (ax, az)]
    v = [Fraction(bx) - p[0], Fraction(bz) - p[1]]
    lo, hi = Fraction(0), Fraction(1)
    for k, (low, high) in enumerate(((x0, x1), (z0, z1))):
        ends = (Fraction(low) - p[k], Fraction(high) - p[k])
        if v[k] == 0:
            if ends[0] > 0 or ends[1] < 0:
                return None
            continue
        t0, t1 = sorted(e / v[k] for e in ends)
        lo, hi = max(lo, t0), min(hi, t1)
    if lo > hi:
        return None
    return tuple(float(p[k] + v[k] * t) for t in (lo, hi) for k in (0, 1))


CLIPPED = "ax double, az double, bx double, bz double"


def clip_exactly(ax: Column, az: Column, bx: Column, bz: Column, bounds: tuple[float, float, float, float]) -> Column:
    @F.pandas_udf(CLIPPED)
    def clip(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [exact_clip(*row, *bounds) if all(x == x and abs(x) != float("inf") for x in row) else None for row in zip(a, b, c, d, strict=True)]
        return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["ax", "az", "bx", "bz"], dtype="float64")

    return clip(ax, az, bx, bz)
