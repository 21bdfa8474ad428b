"""The named random streams of loomgrid.functions.randoms, one draw at a time."""

from __future__ import annotations

from loomgrid.functions.randoms import LCG_INCREMENT, LCG_MULTIPLIER, MASK, ZERO_STATE, hash_value


class Stream:
    def __init__(self, name: str):
        self.state = hash_value(name) or ZERO_STATE

    def next(self) -> float:
        self.state = (self.state * LCG_MULTIPLIER + LCG_INCREMENT) & MASK
        return self.state / 4294967296.0

    def between(self, low: float, high: float) -> float:
        return low + (high - low) * self.next()

    def whole(self, low: int, high: int) -> int:
        return low + int(self.next() * (high - low + 1))

    def chance(self, p: float) -> bool:
        return self.next() < p

    def pick(self, items):
        return items[int(self.next() * len(items))]


def value_noise(seed: str):
    """(x, z) -> -1 .. 1, the same as loomgrid.functions.randoms.noise."""
    from loomgrid.functions.randoms import NOISE_MIX, NOISE_X, NOISE_Z

    base = hash_value(seed)

    def lattice(ix: int, iz: int) -> float:
        h = ((ix * NOISE_X) & MASK) ^ ((iz * NOISE_Z) & MASK) ^ base
        h = ((h ^ (h >> 13)) * NOISE_MIX) & MASK
        return (h ^ (h >> 16)) / 4294967296.0 * 2 - 1

    def at(x: float, z: float) -> float:
        ix, iz = int(x // 1), int(z // 1)
        fx, fz = x - ix, z - iz
        fx, fz = fx * fx * (3 - 2 * fx), fz * fz * (3 - 2 * fz)
        a, b, c, d = lattice(ix, iz), lattice(ix + 1, iz), lattice(ix, iz + 1), lattice(ix + 1, iz + 1)
        return (a + (b - a) * fx) * (1 - fz) + (c + (d - c) * fx) * fz

    return at


def random_seed() -> str:
    """A new seed in letters and digits; the only draw that no seed determines."""
    import secrets
    import string

    n, out = secrets.randbelow(MASK), ""
    while n or not out:
        n, k = divmod(n, 36)
        out = (string.digits + string.ascii_uppercase)[k] + out
    return out
