import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm.permutation_index import LEAST, PIVOTS, PREFIX, SHARE, PermutationIndex, Shard, nearest, spread_pivots


def brute(rows, top, is_query):
    seen = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in filter(is_query, seen):
        found = sorted((float(np.sqrt(((v - seen[q]) ** 2).sum())), i) for i, v in seen.items() if i != q)
        out[q] = [i for _, i in found[:top]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]  # copies of one vector
    rows += [(5000, None), (5010, [0.0] * 8), (5020, [float("nan")] * 8), (5030, [1.0, None] * 4), (5040, []), (5050, [1.0] * 3), (None, [1.0] * 8), (5060, [float("inf")] * 8), (0, rows[0][1])]
    return rows


def test_all_candidates_is_exact(spark):
    rows = made(200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert answers(nearest(df, F.col("vec_id") % 10 == 0, top=5, shard=64, share=1.0)) == brute(rows, 5, lambda i: i % 10 == 0)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int").repartition(4)
    got = answers(nearest(df, F.col("vec_id") % 100 == 0, top=10, shard=3000))
    d = ((vectors[::100, None, :].astype(float) - vectors[None].astype(float)) ** 2).sum(-1)
    hit = sum(len(set(np.argsort(d[k], kind="stable")[1:11]) & set(got[k * 100])) for k in range(60))
    assert hit >= 0.9 * 600


def test_footrule_is_brute_force():
    rng = np.random.default_rng(3)
    v, p = rng.normal(size=(50, 6)), rng.normal(size=(12, 6))
    index = PermutationIndex(v, p, 5)
    orders, q = index.permutations(v), index.permutations(rng.normal(size=(1, 6)))[0]
    place = lambda order, x: list(order).index(x) if x in order else 5
    expected = [sum(abs(place(o, x) - place(q, x)) for x in range(12)) for o in orders]
    assert index.footrule(q).tolist() == expected


def test_recall_beside_a_crowd(spark):
    rng = np.random.default_rng(7)
    center = rng.normal(size=32)
    vectors = np.concatenate([rng.normal(size=(4000, 32)), center + rng.normal(size=(2000, 32)) * 0.01]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    got = answers(nearest(df, F.col("vec_id") % 100 == 0, shard=3000))
    d = ((vectors[::100, None, :].astype(float) - vectors[None].astype(float)) ** 2).sum(-1)
    hits = [len(set(np.argsort(d[k], kind="stable")[1:11]) & set(got[k * 100])) for k in range(60)]
    assert sum(hits) >= 0.9 * 600 and sum(hits[40:]) >= 0.9 * 200


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.5])], "vec_id long, embedding array<float>")
    assert answers(nearest(df, F.col("vec_id") % 100 == 0)) == {0: [100], 100: [0]}
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_candidates_come_from_the_files_at_every_size(n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(40, 64))
    vectors = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * 0.6).astype(np.float32).astype(float)
    pivots = spread_pivots(vectors[rng.permutation(n)[:2048]], PIVOTS)
    ids = pa.array([[i] for i in range(n)], pa.list_(pa.int64()))
    shard = Shard([ids], [pa.array(list(vectors), pa.list_(pa.float64()))], pivots, PREFIX)
    asked = np.arange(0, n, max(1, n // 50))
    Shard.reranked = Shard.searched = hit = 0
    for q, order in zip(asked.tolist(), shard.index.permutations(vectors[asked]), strict=True):
        found = {i for _, i in shard.nearest(q, vectors[q], order, SHARE, LEAST, 10)}
        hit += len(found & set(np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1), kind="stable")[:11].tolist()) - {q})
    assert hit >= 0.95 * 10 * len(asked)
    assert Shard.reranked <= 0.5 * Shard.searched
