"""Approximate nearest neighbours by a permutation index.

Pivots come from a bounded sample of vectors, each away from those before it, so that a crowd of almost equal vectors gives
one. Every vector is represented by its `prefix` nearest pivots in order, and is posted, with its place in that order, in the
inverted file of each of them. A query walks the files of its own pivots, which gives the footrule distance between the two
orders for every vector that shares a pivot (a pivot missing from an order counts as last). The `share` of a shard with the
smallest footrule, `least` at least, is ranked anew by the exact distance; then as many more as `least`, in order of footrule,
for as long as that still brings something nearer, so a crowd of almost equal vectors is ranked whole.

Equal vectors are one entry that carries its smallest ids, `top` + 1 of them, which is all that an answer can hold; a
vector with any number of copies costs one entry. Entries are dealt to shards of about `shard` by a hash. A shard is posted
once, in one task, which then reads the queries batch by batch; nothing grows with the number of queries but time, and a
shard gives at most `top` rows a query.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows with a null id. A repeated row counts once. Ties go to the smaller id. An empty table gives no rows. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.text import trim

PIVOTS, PREFIX = 256, 128
SAMPLED = 8  # vectors looked at for each pivot
APART = 0.5  # least distance of two pivots, in median distances of the sample
SHARE, LEAST = 0.05, 40
SHARD = 16_384

ANSWER = "query_id long, vec_id long, score double"


class PermutationIndex:
    """Inverted files of pivots over the rows of `vectors`."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.vectors, self.pivots, self.prefix = vectors, pivots, min(prefix, len(pivots))
        orders = self.permutations(vectors)
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.prefix).astype(np.int32)
        self.places = (by_pivot % self.prefix).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def permutations(self, vectors: np.ndarray) -> np.ndarray:
        """Each row's nearest pivots, nearest first."""
        orders = np.empty((len(vectors), self.prefix), dtype=np.int32)
        for s in range(0, len(vectors), 4096):
            part = vectors[s : s + 4096]
            far = (self.pivots**2).sum(axis=1)[None, :] - 2 * part @ self.pivots.T
            orders[s : s + 4096] = np.argsort(far, axis=1, kind="stable")[:, : self.prefix]
        return orders

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every row to an order of pivots."""
        k = self.prefix
        shared = np.zeros(len(self.vectors), dtype=np.int32)
        for place, pivot in enumerate(order):
            s, e = self.starts[pivot], self.starts[pivot + 1]
            shared[self.rows[s:e]] += k - np.maximum(self.places[s:e], place)
        return k * (k + 1) - 2 * shared


def _distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


class Shard:
    """The entries of one shard: their ids and the index of their vectors. ids and embedding: one array a batch."""

    reranked = searched = 0  # entries compared exactly, and entries there were, over all queries of this process; for tests

    def __init__(self, ids: list[pa.Array], embedding: list[pa.Array], pivots: np.ndarray, prefix: int):
        members = pa.concat_arrays(ids)
        bounds, self.members = members.offsets.to_numpy(), members.flatten().to_numpy()
        bounds = bounds - bounds[0]
        by_id = np.argsort(self.members[bounds[:-1]], kind="stable")
        self.low, self.high = bounds[:-1][by_id], bounds[1:][by_id]
        self.index = PermutationIndex(_matrix(pa.concat_arrays(embedding))[by_id], pivots, prefix)

    def nearest(self, own: int, query: np.ndarray, order: np.ndarray, share: float, least: int, top: int) -> list[tuple[float, int]]:
        """(distance, id) of the `top` nearest found, without the query's own id."""
        near = np.argsort(self.index.footrule(order), kind="stable")
        at = min(len(near), max(least, int(np.ceil(share * len(near)))))
        far = _distances(self.index.vectors[near[:at]], query)
        while at < len(near):
            cut = np.partition(far, top)[top] if len(far) > top else np.inf
            more = _distances(self.index.vectors[near[at : at + least]], query)
            far, at = np.append(far, more), at + len(more)
            if not (more < cut).any():
                break
        Shard.reranked += at
        Shard.searched += len(near)
        near = near[:at]
        if len(far) > top + 1:
            cut = np.partition(far, top)[top]
            near, far = near[far <= cut], far[far <= cut]
        return sorted((d, int(v)) for d, n in zip(far.tolist(), near, strict=True) for v in self.members[self.low[n] : self.high[n]] if v != own)[:top]


def _matrix(embedding: pa.Array) -> np.ndarray:
    return embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embedding), -1)


def _search(batches: Iterator[pa.RecordBatch], pivots, prefix: int, share: float, least: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, asks, ids, embedding) sorted by shard and asks: a shard's entries, then the queries that it is searched for."""
    table = np.asarray(pivots.value)
    now, held, shard = None, [], None
    for batch in batches:
        key, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(key)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if s == e:
                continue
            if key[s] != now:
                now, held, shard = key[s], [], None
            part = batch.slice(s, e - s)
            if not asks[s]:
                held.append(part)
                continue
            if shard is None:
                if not held:
                    continue
                shard, held = Shard([h.column(2) for h in held], [h.column(3) for h in held], table, prefix), []
            queries, own = _matrix(part.column(3)), part.column(2).flatten().to_pylist()
            found = [(q, v, d) for q, query, order in zip(own, queries, shard.index.permutations(queries), strict=True) for d, v in shard.nearest(q, query, order, share, least, top)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])
    trim()


def spread_pivots(sample: np.ndarray, pivots: int, apart: float = APART) -> np.ndarray:
    """Rows of the sample in its order, without those too close to one taken before."""
    if len(sample) < 2:
        return sample
    half = len(sample) // 2
    least = apart * np.median(_distances(sample[:half], sample[half : 2 * half]) if half else 0.0)
    taken = sample[:1]
    for v in sample[1:]:
        if len(taken) == pivots:
            break
        gap = _distances(taken, v).min()
        if gap >= least and gap > 0:
            taken = np.vstack([taken, v])
    return taken


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", top: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` nearest found for every vector that is_query (a condition on vec_id) holds for."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == lengths["n"])
    shards = max(1, -(-lengths["count"] // shard))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED * pivots).collect()  # a bounded number of vectors
    told = spark.sparkContext.broadcast(spread_pivots(np.array([r["embedding"] for r in sample], dtype=np.float64), pivots))

    each = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("place", F.dense_rank().over(each)).where(F.col("place") <= top + 1)  # Spark drops the rest before the shuffle
    entries = first.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    queries = rows.where(is_query).dropDuplicates(["vec_id", "embedding"])
    index = entries.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "ids", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), F.array("vec_id").alias("ids"), "embedding")
    dealt = index.unionAll(asked).repartition(2 * shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(partial(_search, pivots=told, prefix=prefix, share=share, least=least, top=top), ANSWER)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
