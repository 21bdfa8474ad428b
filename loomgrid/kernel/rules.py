"""What a city is built by: fixed values of density, patterns, setbacks and zones."""

from __future__ import annotations

import math

SIZE = 900.0

# Depth of the rectangle split, least block, parcel side, heights, share of parks and budget of edges by density.
DENSITY = {
    "low": {"depth": 4, "block": 100, "parcel": 58, "height": (8, 42), "park": 0.18, "budget": 620},
    "med": {"depth": 5, "block": 78, "parcel": 48, "height": (12, 72), "park": 0.13, "budget": 980},
    "high": {"depth": 6, "block": 64, "parcel": 40, "height": (18, 118), "park": 0.09, "budget": 1450},
    "extreme": {"depth": 6, "block": 56, "parcel": 34, "height": (22, 170), "park": 0.06, "budget": 1950},
}

# Metres between a road and a building, by zone and the road's class.
SETBACK = {
    "residential": {"arterial": 6, "collector": 4, "local": 3, "boundary": 1, "shore": 4, "bridge": 6},
    "commercial": {"arterial": 4, "collector": 3, "local": 2.5, "boundary": 1, "shore": 4, "bridge": 6},
    "industrial": {"arterial": 7, "collector": 5, "local": 4, "boundary": 1, "shore": 3, "bridge": 7},
    "civic": {"arterial": 8, "collector": 6, "local": 5, "boundary": 1, "shore": 5, "bridge": 7},
    "mixed": {"arterial": 5, "collector": 3.5, "local": 3, "boundary": 1, "shore": 4, "bridge": 6},
}

# How the height of a building goes with its zone.
ZONE_HEIGHT = {"residential": 0.72, "commercial": 1.25, "industrial": 0.42, "civic": 0.88, "mixed": 1.0}


def _classes(arterial: float, collector: float, local: float) -> dict[str, float]:
    return {"arterial": arterial, "collector": collector, "local": local}


# The rules of growth that all patterns share.
BASE = {
    "widths": _classes(20, 13, 9),
    "spacing": (90, 90),
    "length": _classes(1.5, 1, 1),
    "branch": _classes(0.85, 0.85, 0.8),
    "arterial_branch": 0.12,
    "least_people": {"collector": 0.05, "local": 0.12},
    "angle": math.radians(32),
    "snap": 11,
    "extend": 14,
    "shortest": 16,
    "most_turn": 0.45,
    "jitter": 0,
    "stop": _classes(0, 0.02, 0.04),
    "bridge": _classes(1, 0.45, 0.06),
    "bridge_span": 150,
    "grade": _classes(0.24, 0.3, 0.36),
    "deepest": _classes(80, 14, 10),
    "delay": _classes(1, 3, 7),
    "diagonals": 0,
    "through": ("arterial", "collector"),
    "budget": 1,
    "parcel": 1,
    "largest_block": 200 * 200,
    "secondary": 1,
    "noise": 0,
    "noise_scale": 1 / 150,
}

# What each pattern changes.
PATTERNS = {
    "manhattan": {"spacing": (62, 175), "length": _classes(1.15, 1, 1), "branch": _classes(1, 0.98, 0.95), "arterial_branch": 0.2, "diagonals": 1, "most_turn": 0.25, "least_people": {"collector": 0.03, "local": 0.05}, "budget": 1.1},
    "paris": {"widths": _classes(24, 13, 8), "spacing": (95, 85), "length": _classes(1.3, 1, 0.9), "arterial_branch": 0.22, "most_turn": 0.5, "jitter": 0.04, "noise": 0.14, "noise_scale": 1 / 170, "secondary": 2, "parcel": 0.9},
    "tokyo": {"widths": _classes(18, 11, 6), "spacing": (52, 46), "length": _classes(1.8, 1.1, 1), "branch": _classes(0.8, 0.9, 0.85), "arterial_branch": 0.06, "angle": math.radians(28), "snap": 8, "extend": 11, "shortest": 12, "most_turn": 0.6, "jitter": 0.16, "noise": 0.55, "noise_scale": 1 / 130, "secondary": 2, "budget": 1.5, "parcel": 0.62, "stop": _classes(0, 0.03, 0.08)},
    "medieval": {"widths": _classes(12, 8, 5), "spacing": (42, 36), "length": _classes(1.4, 1, 0.9), "branch": _classes(0.9, 0.9, 0.8), "arterial_branch": 0.1, "angle": math.radians(25), "snap": 7, "extend": 10, "shortest": 10, "most_turn": 0.7, "jitter": 0.3, "noise": 0.8, "noise_scale": 1 / 90, "secondary": 0, "budget": 1.4, "parcel": 0.5, "least_people": {"collector": 0.12, "local": 0.22}, "stop": _classes(0, 0.05, 0.1), "largest_block": 150 * 150},
    "atlanta": {"widths": _classes(24, 14, 9), "spacing": (130, 110), "length": _classes(1.6, 1, 0.75), "branch": _classes(0.75, 0.7, 0.6), "arterial_branch": 0.1, "most_turn": 0.3, "jitter": 0.14, "noise": 0.4, "noise_scale": 1 / 240, "secondary": 2, "diagonals": 1, "budget": 0.85, "parcel": 1.9, "least_people": {"collector": 0.08, "local": 0.16}, "stop": _classes(0, 0.06, 0.3), "largest_block": 320 * 320},
}


def rules_of(pattern: str) -> dict:
    """Rules of a pattern; an unknown one is manhattan."""
    name = pattern if pattern in PATTERNS else "manhattan"
    own = BASE | PATTERNS[name] | {"name": name}
    return own | {"gap": max(own["snap"], 0.45 * min(own["spacing"]))}


#: Where a pattern's directions come from: kind, at which centres (None: everywhere), weight, and reach.
DIRECTIONS = {
    "paris": (("radial", slice(None), 1.0, 200.0), ("grid", None, 0.3, math.inf)),
    "tokyo": (("grid", slice(None), 0.8, 150.0), ("grid", None, 0.4, math.inf)),
    "medieval": (("radial", slice(1), 1.0, 300.0), ("grid", None, 0.25, math.inf)),
    "atlanta": (("grid", slice(None), 0.7, 220.0), ("grid", None, 0.5, math.inf)),
}


def sources_of(pattern: str, rng, centers: list[tuple[float, float]]) -> list[dict]:
    """Sources of direction; a pattern without any of its own is one grid that is turned a little."""
    found = []
    for kind, where, weight, reach in DIRECTIONS.get(pattern, ()):
        for x, z in [(0.0, 0.0)] if where is None else centers[where]:
            source = {"type": kind, "x": x, "z": z, "sigma": reach, "weight": weight}
            found.append(source | ({"angle": rng.between(0, math.pi / 2)} if kind == "grid" else {}))
    return found or [{"type": "grid", "angle": rng.between(-0.4, 0.4), "x": 0.0, "z": 0.0, "sigma": math.inf, "weight": 1.0}]
