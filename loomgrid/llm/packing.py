"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document becomes its ids and a closing id, cut into as many whole windows as it holds, so that a long document keeps its
order, and a rest, which stays whole (or in pieces of at most `piece` ids). All pieces are gathered within each task into
groups of `group`. A group is dealt to ceil(ids / capacity) windows: each piece begins as a partial partition of its own, and
the two partial partitions with the largest imbalances are merged again and again, the fullest window of one with the emptiest
of the other. What the windows of this first dealing hold beyond the capacity is cut off their smallest pieces. The group is then
dealt with these cuts in the same way; if the fullest window still exceeds the capacity, the group gets one window more and is dealt
anew. So only what has no room is cut, and the short ends fill up the others. Nothing is shuffled; a task holds one group
and one batch of documents.

Sequences of a power of two ids need no padding; all others count as padded to the capacity. sequence_id is unique: the
task's partition in the upper bits, a counter in the lower 32. Over the same input splits the result is the same again.

Null and empty texts are the closing id alone. Repeated rows and null ids are packed like others; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.text import trim
from loomgrid.llm.vocabulary import byte_bpe, default_path, encode

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of positions in sizes, by multiway differencing; the fullest first."""
    # a partial partition: (sum, positions) of its windows that hold something, the fullest first
    heap = [(-s, n, [(s, [n])]) for n, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:
            merged = a + b
        else:  # the fullest of b go to windows of their own, its others meet the emptiest of a, fullest with emptiest
            alone = len(a) - (len(b) - free)
            merged = a[:alone] + b[:free]
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(reversed(a[alone:]), b[free:], strict=True)]
        merged.sort(key=lambda w: -w[0])
        order += 1
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), order, merged))
    windows = [p for _, p in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of positions, none beyond the capacity; one window more whenever the differencing exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[n] for n in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def cuts(sizes: list[int], capacity: int) -> list[list[int]]:
    """Each size in the parts that it is cut in: what the windows of a dealing into the fewest windows hold beyond the capacity is
    cut off the ends of their smallest pieces, whole windows aside."""
    parts = [[s] for s in sizes]
    for window in difference(sizes, max(1, -(-sum(sizes) // capacity))):
        over = sum(sizes[n] for n in window) - capacity
        for n in sorted(window, key=lambda n: sizes[n]):
            if over <= 0 or sizes[n] == capacity:
                break
            off = min(over, sizes[n])
            over -= off
            if off < sizes[n]:
                parts[n] = [sizes[n] - off, off]
    return parts


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, piece: int, group: int, close: int) -> Iterator[pa.RecordBatch]:
    encoding = byte_bpe(path)
    task = TaskContext.get()
    base, count = (task.partitionId() if task else 0) << 32, 0
    waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
    rows: list[tuple] = []
    held = 0
    end = np.array([close], dtype=np.uint32)

    def emit(window: list[tuple]) -> None:
        nonlocal count, held
        offset = 0
        for doc, start, ids, total in window:
            rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, base + count, offset))
            offset += len(ids)
        held += offset
        count += 1

    def out() -> pa.RecordBatch:
        nonlocal rows, held
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        rows, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def close_group() -> None:
        pieces = []
        for (doc, start, ids, total), parts in zip(waiting[:group], cuts([len(p[2]) for p in waiting[:group]], capacity), strict=True):
            at = 0
            for n in parts:
                pieces.append((doc, start + at, ids[at : at + n], total))
                at += n
        for window in deal([len(p[2]) for p in pieces], capacity):
            emit([pieces[n] for n in window])
        del waiting[:group]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.concatenate([encode(encoding, text.as_py() or ""), end])
            whole = len(ids) // capacity * capacity
            waiting += [(doc, start, ids[start : start + capacity].copy(), len(ids)) for start in range(0, whole, capacity)]
            rest = len(ids) - whole
            parts = -(-rest // piece)
            for n in range(parts):
                s, e = whole + rest * n // parts, whole + rest * (n + 1) // parts
                waiting.append((doc, s, ids[s:e].copy(), len(ids)))
            while len(waiting) >= group:
                close_group()
            if held >= 1 << 20:
                yield out()
    if waiting:
        close_group()
    yield out()
    trim()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = CAPACITY, group: int = 512, close: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if not 0 < piece <= capacity:
        raise ValueError("a piece must fit in a sequence")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(partial(_pack, path=vocabulary or default_path("byte_bpe_50k.tiktoken"), capacity=capacity, piece=piece, group=group, close=close), PIECES)
