"""Shards of nearly equal bytes by longest-processing-time scheduling; equal texts stay together.

A document's size is the UTF-8 bytes of its text plus 1. Documents of equal text form a group; groups go, the largest first, to
the shard with the fewest bytes so far, by a heap. Groups can be as many as documents, so neighbours in that order travel as one
item while together they are small against all that is still to come: with `rest` bytes to come, an item takes groups while
rest falls by a factor of exp(1 / resolution). A group of more than 1/resolution of the rest is an item of its own, hence so are
the last `resolution` groups at least, and a table of no more groups is dealt exactly as a plain heap deals it. Items are at
most resolution * ln(bytes) + 1, whatever the input's size (30,000 for 100 TB); these pass the driver's heap, nothing else does.
Only digests and numbers are shuffled. A group with a large share of the rows goes to its documents instead of gathering them.

Defined cases: a null text has no bytes, so it is of size 1 and belongs to the group of the empty text. Repeated rows and null ids are
documents like others. An empty table gives no rows. Equal sizes go by the text's digest, so the shards depend on the rows
alone; slots count a shard's documents in the order they are read. Other columns play no part. A group of more bytes than a
shard's share has a shard of its own, as it must stay together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.hot import meet
from loomgrid.operators.shared import cut

RESOLUTION = 1024


def schedule(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, in the given order: always the one with the least load, the first of equals."""
    heap = [(0, s) for s in range(shards)]
    dealt = []
    for size in sizes:
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        dealt.append(s)
    return dealt


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("digest"))


def _items(keys: DataFrame, resolution: int) -> DataFrame:
    """(digest, bytes, docs, item): groups, and the place of each one's item in the order of sizes."""
    groups = keys.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs"))
    placed = cut(groups.repartitionByRange(F.desc("bytes"), "digest").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.sum("bytes").alias("own"))
    whole = Window.orderBy(F.desc("part"))  # a row a partition
    rests = sums.select("part", F.sum("own").over(whole).alias("rest"), F.sum("own").over(Window.partitionBy()).alias("total"))
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy(F.desc("bytes"), "digest")) - F.col("bytes")
    found = placed.withColumn("before", before).join(F.broadcast(rests), "part")
    item = F.floor(F.log(F.col("total") / (F.col("rest") - F.col("before"))) * resolution).cast("int")
    return found.select("digest", "bytes", "docs", item.alias("item"))


def plan(keys: DataFrame, shards: int, resolution: int = RESOLUTION) -> DataFrame:
    """(digest, docs, shard): the shard of each group of keys (digest, size)."""
    groups = cut(_items(keys, resolution))
    items = groups.groupBy("item").agg(F.sum("bytes").alias("bytes")).orderBy("item").collect()  # bounded by resolution * ln(bytes) + 1
    dealt = list(zip([r["item"] for r in items], schedule([r["bytes"] for r in items], shards), strict=True))
    where = keys.sparkSession.createDataFrame(dealt, "item int, shard int")
    return groups.join(F.broadcast(where), "item").select("digest", "docs", "shard")


def assign(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", resolution: int = RESOLUTION) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, and slot, which counts a shard's documents from 0 without gaps."""
    if shards < 1 or resolution < 1:
        raise ValueError("shards and resolution have to be positive")
    keys = cut(_keys(docs, doc_id, text))
    groups = cut(plan(keys, shards, resolution))
    placed = cut(meet(keys, groups, ["digest"], "docs", keys.count()).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"))
    first = counts.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1
    found = placed.withColumn("part", part).withColumn("own", own).join(F.broadcast(first), ["part", "shard"])  # a row a partition and shard
    return found.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("own")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", resolution: int = RESOLUTION, files: int = 1) -> None:
    """Writes docs, all columns kept, to path/shard=N, `files` files a shard at least."""
    if "shard" in docs.columns:
        raise ValueError("docs have a column named shard, which the folders are named by")
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)
    keys = cut(docs.select(F.lit(None).cast("long").alias("doc_id"), digest.alias("digest"), (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")) + F.lit(1)).cast("long").alias("size")))
    groups = cut(plan(keys, shards, resolution))
    nested = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"))
    found = meet(nested, groups, ["digest"], "docs", keys.count())
    dealt = found.repartition(shards * files, "shard", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)
