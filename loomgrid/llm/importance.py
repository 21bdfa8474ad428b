"""Quality classifier by importance resampling: hashed n-gram models of the target and of the raw text.

Texts are words and runs of other signs in lower case; their unigrams and bigrams are hashed to `buckets`. The raw model
counts every document, the target model those of a bounded sample of labelled rows (`sample`, the smallest of a seeded
hash) that have the wanted label. A document's log weight is the sum over its n-grams of log target - log raw. With
Gumbel noise of a seeded hash of the id added, the k largest are what drawing k documents by weight without replacement
gives. k is the number of documents whose log weight reaches `threshold`, by default the one that errs least on the
sample's labels (zero without labels of both kinds); or it is given. Log weights are sums over whole texts, mostly far larger
than the noise, which so decides only among documents near the border.

Null and empty texts have log weight 0. Rows with a null id get the noise of no id. Rows with equal ids and texts have
equal keys, and those that tie for the last place are all taken; an id's label is held against the mean of its rows' weights. An empty table gives no rows; no usable label gives log
weight 0 for all. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.text import trim
from loomgrid.operators.shared import checked, cut

BUCKETS = 10_000
SAMPLE = 20_000
SEED = 42
WORD = re.compile(r"\w+|[^\w\s]+")
PART = 4_000_000  # characters of a long text taken at once
GAP = re.compile(r"\s")


def parts(text: str) -> Iterator[str]:
    """The text, cut at white space if it is long."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Hasher:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        """Buckets of the unigrams and bigrams of a text, in parts of bounded size."""
        last = None
        for part in parts(text):
            words = WORD.findall(part.lower())
            if len(self.known) > 100_000:
                self.known.clear()
            known, hashes = self.known, []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = known[w] = zlib.crc32(w.encode())
                hashes.append(h)
            if hashes:
                yield self._grams(hashes, last)
                last = hashes[-1]

    def _grams(self, part: list[int], last: int | None) -> np.ndarray:
        one = np.array(part if last is None else [last, *part], dtype=np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17)
        single = one if last is None else one[1:]
        return np.concatenate([single, two]) % np.uint64(self.buckets)


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns: text, target (boolean). One row per bucket that the partition holds."""
    grams, raw, target = Hasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for found in grams(text.as_py() or ""):
                n = np.bincount(found.astype(np.int64), minlength=buckets)
                raw += n
                if wanted:
                    target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], names=["bucket", "raw", "target"])
    trim()


def _weights(batches: Iterator[pa.RecordBatch], ratio, buckets: int) -> Iterator[pa.RecordBatch]:
    grams, table = Hasher(buckets), ratio.value
    for batch in batches:
        total = [sum(float(table[found].sum()) for found in grams(text.as_py() or "")) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), batch.column(2)], names=["doc_id", "log_weight", "text_hash"])
    grams.known.clear()
    trim()


def sampled_labels(labels: DataFrame, wanted, doc_id: str = "doc_id", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(label_id, good): the bounded sample that the models and the threshold are fitted on; one label per id."""
    rows = labels.select(F.col(doc_id).cast("long").alias("label_id"), wanted.cast("boolean").alias("good")).where("label_id is not null and good is not null")
    once = rows.groupBy("label_id").agg(F.min("good").alias("good"))
    return once.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, buckets: int) -> np.ndarray:
    """log target - log raw by bucket. labels: of sampled_labels(), so at most its bound of rows is broadcast."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    marked = rows.join(F.broadcast(labels), F.col("i") == F.col("label_id"), "left").select("t", F.coalesce("good", F.lit(False)).alias("target"))
    counted = marked.mapInArrow(partial(_counts, buckets=buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():  # a row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def best_threshold(pairs: list[tuple[float, bool]]) -> float:
    """The threshold with the fewest wrong labels (log weight >= threshold reads good), in the middle of the gap; 0 without both kinds."""
    pairs = sorted(pairs)
    good = sum(g for _, g in pairs)
    if not 0 < good < len(pairs):
        return 0.0
    weights = np.array([w for w, _ in pairs])
    is_good = np.array([g for _, g in pairs])
    lost, spared = (np.concatenate([[0], np.cumsum(x)]) for x in (is_good, ~is_good))
    wrong = lost + spared[-1] - spared  # of a threshold just below the k-th weight
    allowed = np.concatenate([[True], weights[1:] > weights[:-1], [True]])
    wrong = np.where(allowed, wrong, len(pairs) + 1)
    k = int(np.argmin(wrong))
    low = weights[k - 1] if k else weights[0] - 1
    high = weights[k] if k < len(weights) else weights[-1] + 1
    return float((low + high) / 2)


def score(docs: DataFrame, labels: DataFrame, wanted, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = SEED, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected: one row per row of docs."""
    return _scored(docs, labels, wanted, doc_id, text, buckets, sample, seed, threshold, k).drop("text_hash")


def _scored(docs: DataFrame, labels: DataFrame, wanted, doc_id: str, text: str, buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = SEED, threshold: float | None = None, k: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    told = cut(sampled_labels(labels, wanted, sample=sample, seed=seed))
    ratio = spark.sparkContext.broadcast(fit(docs, told, doc_id, text, buckets))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    weighed = rows.mapInArrow(partial(_weights, ratio=ratio, buckets=buckets), "doc_id long, log_weight double, text_hash long")
    uniform = (F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = cut(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))
    if k is None:
        if threshold is None:
            labelled = keyed.join(F.broadcast(told), F.col("doc_id") == F.col("label_id")).groupBy("label_id")
            pairs = labelled.agg(F.avg("log_weight").alias("log_weight"), F.first("good").alias("good")).collect()  # a row a label of the sample
            threshold = best_threshold([(r["log_weight"], r["good"]) for r in pairs])
        k = keyed.where(F.col("log_weight") >= threshold).count()
    least = kth_largest(keyed, "gumbel_key", k)
    return keyed.withColumn("selected", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (the smallest, if there are fewer), by narrowing histograms of 1024 bins; None if k or the table is empty."""
    if k <= 0:
        return None
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    if k >= n:
        return low
    above = 0  # rows beyond high
    while low < high:
        step = (high - low) / 1024
        if not step or low + step == low or high - step == high:
            return rows.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()[0]
        inside = rows.where(F.col(column).between(low, high)).withColumn("bin", F.least(F.lit(1023), F.floor((F.col(column) - low) / step)))
        bins = sorted(inside.groupBy("bin").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), reverse=True)
        for b in bins:  # at most 1024
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low


def keep(docs: DataFrame, labels: DataFrame, wanted, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The selected rows of docs with all their columns. A row is known by its id and its text together, so rows of one id, or without
    any, are decided on one by one; rows that are equal in both have one weight and one key, and share their fate."""
    scored = _scored(docs, labels, wanted, doc_id, text, **options)
    gone = cut(scored.where("not selected").select(F.col("doc_id").alias("gone_id__"), F.col("text_hash").alias("gone_text__")).distinct())
    same = docs[doc_id].cast("long").eqNullSafe(gone["gone_id__"]) & (F.xxhash64(docs[text].cast("string")) == gone["gone_text__"])
    return docs.join(checked(gone, gone.count()), same, "left_anti")
