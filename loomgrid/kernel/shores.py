"""Shores with few corners: the ones that matter most stay, and no chord leads over land."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

from loomgrid.kernel.plane import Point, foot

MOST = 24


def over_land(a: Point, b: Point, water: Callable[[float, float], float], clear: float = 0.5) -> bool:
    """Whether a chord runs more than `clear` inland; water() is negative on water."""
    n = max(2, math.ceil(math.dist(a, b) / 2))
    return any(water(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) > clear for k in range(1, n))


def thin(points: list[Point], closed: bool, water: Callable[[float, float], float], most: int = MOST) -> list[tuple[list[Point], bool]]:
    """(points, closed) of the pieces of a shore with at most `most` corners in all.

    Corners come back one by one, always to the chord that is worst: those over land first, then the one that strays
    furthest from the shore. Chords that are still over land at the end are left out, which splits the shore."""
    if len(points) <= most:
        return [(points, closed)]
    n = len(points)
    last = n if closed else n - 1
    at = lambda k: points[k % n]
    heap: list[tuple] = []

    def add(a: int, b: int) -> None:
        inner = range(a + 1, b)
        far = max(inner, key=lambda k: (foot(at(k), at(a), at(b))[0], -k), default=None)
        if far is not None:
            heapq.heappush(heap, (not over_land(at(a), at(b), water), -foot(at(far), at(a), at(b))[0], a, b, far))

    kept = {0, n // 2, last} if closed else {0, last}
    order = sorted(kept)
    for a, b in zip(order, order[1:], strict=False):
        add(a, b)
    while heap and len(kept) - closed < most:
        _, _, a, b, far = heapq.heappop(heap)
        kept.add(far)
        add(a, far)
        add(far, b)
    order = sorted(kept)
    pieces: list[list[Point]] = [[at(order[0])]]
    for a, b in zip(order, order[1:], strict=False):
        if over_land(at(a), at(b), water):
            pieces.append([at(b)])
        else:
            pieces[-1].append(at(b))
    if closed and len(pieces) == 1:
        return [(pieces[0][:-1], True)]
    return [(p, False) for p in pieces if len(p) > 1]
