import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomgrid.llm.importance import BUCKETS, Hasher, best_threshold, keep, kth_largest, score


def made(n=600, seed=5):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice("the of and to in city river house green road".split()) for _ in range(40)) + "."
    bad = lambda: rng.choice((" ".join(["buy"] * 30), " ".join(f"{rng.choice('the of and'.split())}***" for _ in range(30)), "NOW!! " * 20))
    docs, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.8)
        docs.append((i, good() if q else bad()))
        if rng.random() < 0.4:
            labels.append((i, q))
    return docs, labels, {i: int(t.startswith(("buy", "NOW")) or "***" in t) for i, t in docs}


def test_held_out_accuracy(spark):
    docs, labels, junk = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    told = score(d, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("quality") == 1).collect()
    known = {i for i, _ in labels}
    right = [r.selected != bool(junk[r.doc_id]) for r in told if r.doc_id not in known]
    assert sum(right) >= 0.98 * len(right)


def test_weights_are_brute_force(spark):
    docs, labels, _ = made(80)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    told = {r.doc_id: r for r in score(d, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("quality") == 1, k=10).collect()}
    grams = {i: [int(g) for part in Hasher(BUCKETS)(t) for g in part] for i, t in docs}
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, gs in grams.items():
        np.add.at(raw, gs, 1)
        if (i, 1) in labels:
            np.add.at(target, gs, 1)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    for i, gs in grams.items():
        assert math.isclose(told[i].log_weight, ratio[gs].sum(), abs_tol=1e-6)
    best = sorted(told.values(), key=lambda r: -r.gumbel_key)[:10]
    assert {r.doc_id for r in best} == {r.doc_id for r in told.values() if r.selected}


def test_threshold_and_selection(spark):
    assert best_threshold([(1.0, True), (0.0, False), (3.0, True)]) == 0.5
    assert best_threshold([(1.0, True)]) == 0.0
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1e6), 1.5, -2.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for k in (1, 2, 77, 1500, 2999, 3000, 4000):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 3000) - 1]
    assert kth_largest(df, "v", 0) is None


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "good words here", 0), (2, None, 0), (None, "x " * 100_000, 0), (1, "good words here", 0)], "doc_id long, text string, selected int")
    told = score(docs, labels, F.col("quality") == 1).collect()
    assert len(told) == 4 and [r.log_weight for r in told if r.doc_id == 2] == [0.0]
    assert keep(docs, labels, F.col("quality") == 1).columns == docs.columns
    assert score(docs.limit(0), labels, F.col("quality") == 1).count() == 0
    none = labels.limit(0)
    assert {r.log_weight for r in score(docs, none, F.col("quality") == 1).collect()} == {0.0}


def test_rows_of_one_id_are_decided_on_one_by_one(spark):
    docs, labels, _ = made(80)
    told = {i: q for i, q in labels if i is not None}
    good, bad = (next(t for i, t in docs if told.get(i) == q) for q in (1, 0))
    rows = docs + [(500_000, good), (500_000, bad), (None, good), (None, bad), (None, None)]
    d = spark.createDataFrame([(t, i, 9) for i, t in rows], "text string, doc_id long, log_weight int").repartition(4)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = sorted(map(tuple, keep(d, label_rows, F.col("quality") == 1).collect()), key=str)
    scored = score(d, label_rows, F.col("quality") == 1).collect()
    assert len(kept) == sum(r.selected for r in scored)
    for i in (500_000, None):
        assert (good, i, 9) in kept and (bad, i, 9) not in kept
