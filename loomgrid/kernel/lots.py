"""Rings with common boundary: their union, and the folding of lots without frontage into their neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

from loomgrid.kernel.plane import Ring, area, foot, tidy

TOL = 1e-6


def _cuts(ring: Ring, other: Ring) -> list[tuple]:
    """Directed edges of a ring, cut where corners of the other one lie on them."""
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        ts = [0.0, 1.0] + [t for v in other for d, t in (foot(v, p, q),) if d <= TOL and TOL < t < 1 - TOL]
        at = [(p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t) for t in sorted(set(ts))]
        out += [(a, b) for a, b in zip(at, at[1:], strict=False) if math.dist(a, b) > TOL]
    return out


def _key(p) -> tuple[int, int]:
    return round(p[0] * 1e4), round(p[1] * 1e4)


def shared_length(a: Ring, b: Ring) -> float:
    """Length of boundary that two counter-clockwise rings have in common, running opposite ways."""
    back = {(_key(q), _key(p)) for p, q in _cuts(b, a)}
    return sum(math.dist(p, q) for p, q in _cuts(a, b) if (_key(p), _key(q)) in back)


def union(a: Ring, b: Ring) -> Ring | None:
    """The union of two rings that share boundary, if it is one ring without a hole; None otherwise."""
    one, two = _cuts(a, b), _cuts(b, a)
    mine, theirs = {(_key(p), _key(q)) for p, q in one}, {(_key(p), _key(q)) for p, q in two}
    left = [(p, q) for p, q in one if (_key(q), _key(p)) not in theirs] + [(p, q) for p, q in two if (_key(q), _key(p)) not in mine]
    if len(left) == len(one) + len(two) or len(left) < 3:
        return None
    follow: dict[tuple, tuple] = {}
    for p, q in left:
        if _key(p) in follow:
            return None  # the rings touch in a point as well
        follow[_key(p)] = (p, q)
    start = at = _key(left[0][0])
    ring: Ring = []
    while True:
        if at not in follow:
            return None
        p, q = follow.pop(at)
        ring.append(p)
        at = _key(q)
        if at == start:
            break
    ring = straight(tidy(ring))
    whole = area(a) + area(b)
    return ring if not follow and len(ring) >= 3 and abs(area(ring) - whole) <= max(1e-3, whole * 1e-6) else None


def straight(ring: Ring) -> Ring:
    """Without corners that lie on the line between their neighbours."""
    n = len(ring)
    return [p for k, p in enumerate(ring) if foot(p, ring[k - 1], ring[(k + 1) % n])[0] > TOL]


def fold(lots: list[Ring], frontage: Callable[[Ring], tuple | None]) -> list[tuple[Ring, tuple | None]]:
    """Lots with their frontage. A lot without one goes to the neighbour with the longest common boundary, the first of equals,
    as long as it is linked to a lot that has one; islands without any stay."""
    rings: dict[int, Ring] = dict(enumerate(lots))
    front = {k: frontage(r) for k, r in rings.items()}
    ahead = [k for k in rings if front[k] is None]
    waited = 0
    while ahead and waited <= len(ahead):
        k = ahead.pop(0)
        options = sorted(((-round(shared_length(rings[k], r), 6), m) for m, r in rings.items() if m != k))
        merged = next(((m, u) for n, m in options if n < 0 and (front[m] is not None) for u in (union(rings[k], rings[m]),) if u), None)
        if merged is None:
            ahead.append(k)  # a neighbour may get frontage yet
            waited += 1
            continue
        m, u = merged
        rings[m], front[m], waited = u, frontage(u), 0
        if front[m] is None:
            ahead.append(m)
        del rings[k], front[k]
    return [(rings[k], front[k]) for k in rings]
