"""Seeded randomness as Column expressions: a 32-bit string hash, a linear congruential stream and value noise.

Streams are named: the state of a stream is the hash of "<seed>:<name>", so one part of a job cannot reshuffle another.
All arithmetic is on bigint with masks, as 32-bit wrap-around is an error under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a basis and prime, the congruential multiplier and increment, and the state that stands for zero.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
LCG_MULTIPLIER, LCG_INCREMENT = 1664525, 1013904223
ZERO_STATE = 0x9E3779B9
# The lattice hash of the noise.
NOISE_X, NOISE_Z, NOISE_MIX = 374761393, 668265263, 1274126177
MASK = (1 << 32) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _mask(c: Column) -> Column:
    return c.bitwiseAND(_long(MASK))


def code_units(text: Column) -> Column:
    """UTF-16 code units of a string, as array<bigint>."""
    wide = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(wide) / 4).cast("int")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 0, F.transform(at, lambda k: F.conv(F.substring(wide, k * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hash_text(text: Column) -> Column:
    """FNV-1a over UTF-16 code units (each unit is folded in whole), 0 .. 2^32-1."""
    return F.aggregate(code_units(text), _long(FNV_BASIS), lambda h, c: _mask(h.bitwiseXOR(c) * FNV_PRIME))


def stream(seed: Column, name: str | None = None) -> Column:
    """Initial state of the stream of a seed."""
    state = hash_text(F.concat(seed.cast("string"), F.lit(f":{name}")) if name is not None else seed.cast("string"))
    return F.when(state == 0, _long(ZERO_STATE)).otherwise(state)


def step(state: Column) -> Column:
    return _mask(state * LCG_MULTIPLIER + LCG_INCREMENT)


def draw(state: Column, k: Column | int) -> Column:
    """The k-th draw (from 1) of a stream, in [0, 1)."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.aggregate(F.sequence(F.lit(1), k), state, lambda s, _: step(s)) / F.lit(4294967296.0)


def draws(state: Column, n: int) -> Column:
    """The first n draws, as array<double>."""
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(state), lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1)))))
    return F.transform(F.slice(folded, 2, n), lambda s: s / F.lit(4294967296.0))


def between(u: Column, low: float | Column, high: float | Column) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * u


def whole(u: Column, low: int, high: int) -> Column:
    return F.lit(low) + F.floor(u * (high - low + 1))


def chance(u: Column, p: float | Column) -> Column:
    return u < F.lit(p)


def pick(u: Column, items: Column) -> Column:
    return F.element_at(items, (F.floor(u * F.size(items)) + 1).cast("int"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lattice(ix: Column, iz: Column, base: int) -> Column:
    """Noise at a lattice point, -1 .. 1. base: the hash of the noise's seed."""
    h = _mask(_mask(ix) * NOISE_X).bitwiseXOR(_mask(_mask(iz) * NOISE_Z)).bitwiseXOR(_long(base))  # below 2^63, as the factors are below 2^31
    mixed = lambda h: _mask(h.bitwiseXOR(F.shiftrightunsigned(h, 13)) * NOISE_MIX)
    return let(mixed(h), lambda g: g.bitwiseXOR(F.shiftrightunsigned(g, 16)) / F.lit(4294967296.0) * 2 - 1)


def hash_value(text: str) -> int:
    """hash_text() of a Python string."""
    h = FNV_BASIS
    raw = text.encode("utf-16-be", "surrogatepass")
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * FNV_PRIME) & MASK
    return h


def noise(seed: str, x: Column, z: Column) -> Column:
    """Smooth value noise, -1 .. 1; seeds are constants of a job, so their hash is folded into the plan."""
    base = hash_value(seed)
    fade = lambda t: t * t * (3 - 2 * t)

    def at(p: Column) -> Column:
        ix, iz, fx, fz = (p[k] for k in ("ix", "iz", "fx", "fz"))
        a, b, c, d = lattice(ix, iz, base), lattice(ix + 1, iz, base), lattice(ix, iz + 1, base), lattice(ix + 1, iz + 1, base)
        return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")), lambda v: (v["a"] + (v["b"] - v["a"]) * fx) * (1 - fz) + (v["c"] + (v["d"] - v["c"]) * fx) * fz)

    floor = lambda v: F.floor(v).cast("long")
    return let(F.struct(x.alias("x"), z.alias("z")), lambda q: let(F.struct(floor(q["x"]).alias("ix"), floor(q["z"]).alias("iz"), fade(q["x"] - F.floor(q["x"])).alias("fx"), fade(q["z"] - F.floor(q["z"])).alias("fz")), at))
