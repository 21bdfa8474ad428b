"""Bloom filters of bounded size over 64-bit keys, one for each range of keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 256
#: All filters together never take more than this many bits (64 MiB).
MAX_BITS = 1 << 29
MIN_BITS = 1 << 10
PROBES = 4


def part_of(key):
    """The range of a signed key or an array of them: its first bits."""
    return (key >> 56) + PARTS // 2


def part_of_column(key: Column) -> Column:
    return F.shiftright(key, 56) + PARTS // 2


def bits_for(keys: int, most: int = MAX_BITS // PARTS) -> int:
    """A power of two with some 16 bits a key, within the bounds."""
    want = max(MIN_BITS, 16 * max(1, keys))
    return min(most, 1 << (want - 1).bit_length())


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """keys: uint64, already well mixed."""
    low = keys & np.uint64(0xFFFFFFFF)
    high = (keys >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (low[None, :] + steps * high[None, :]) & np.uint64(bits - 1)


def might_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key (uint64), whether it may be in the filter; false is certain."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    at = _places(keys, len(table) * 8)
    return ((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def filled(keys: np.ndarray, bits: int) -> np.ndarray:
    """The filter of some keys (uint64)."""
    table = np.zeros(bits // 8, dtype=np.uint8)
    at = _places(keys, bits).ravel()
    np.bitwise_or.at(table, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return table


def might_hold_parts(tables: list[bytes | None], keys: np.ndarray) -> np.ndarray:
    """For each signed key, whether the filter of its range may hold it."""
    out = np.zeros(len(keys), dtype=bool)
    parts = part_of(keys)
    for part in np.unique(parts).tolist():
        if (table := tables[part]) is not None:
            at = np.flatnonzero(parts == part)
            out[at] = might_hold(np.frombuffer(table, dtype=np.uint8), keys[at].view(np.uint64))
    return out


def _fill_parts(batches):
    """Rows (part, keys, n of the whole part) sorted by part: one filter a part, of which no task holds more than one."""
    now, table = None, None
    for batch in batches:
        for part, keys, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([table.tobytes()], pa.binary())], names=["part", "blob"])
                now, table = part, np.zeros(bits_for(n) // 8, dtype=np.uint8)
            table |= filled(keys.values.to_numpy().view(np.uint64), len(table) * 8)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([table.tobytes()], pa.binary())], names=["part", "blob"])


def by_part(keys: DataFrame) -> list[bytes | None]:
    """keys: (part, keys array<long>), a written table. The filter of each part that has keys, within MAX_BITS for all."""
    sizes = F.broadcast(keys.groupBy("part").agg(F.sum(F.size("keys")).alias("n")))  # a row a part
    dealt = keys.join(sizes, "part").select("part", "keys", "n").repartition(PARTS // 8, "part").sortWithinPartitions("part")
    tables: list[bytes | None] = [None] * PARTS
    for row in dealt.mapInArrow(_fill_parts, "part long, blob binary").toLocalIterator():
        tables[row["part"]] = bytes(row["blob"])
    return tables
