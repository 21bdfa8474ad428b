"""Exact dedup by a log-structured merge index.

1. Each task keeps a memtable of digests. A full memtable is flushed as a sorted run (digest, smallest id, rows).
2. Compaction deals the runs out by digest and merges them in order; it keeps the smallest id and the number of rows of each
   digest that more than one row has. Each range of digests is a compacted run with a filter of its own, sized by its keys.
3. Documents look their digest up in the filter of its range. What the filter rules out is alone in its group and is answered
   on the spot. Possible hits go on as runs with one copy of a text for each memtable.
4. The texts of hits are compared byte for byte. Where all texts of a digest are equal, as they are but for collisions, the
   index's smallest id and row count answer for the rows; the texts themselves take no part in that join. Where they
   aren't, each text's own smallest id and count do.

A group of copies costs one row per memtable after step 1, so a group with a third of all rows is spread over all tasks; texts
are compared by a grouping that first joins equal ones within each task. All filters together take at most filters.MAX_BITS
bits; beyond some 50 million repeated digests they let more strangers through, which costs time but no result.

Null texts count as empty; null ids come after all others. Of rows with the same text and the same id one is kept. An
empty table gives no rows. Other columns play no part and may have any names (dedup_keep returns them unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm import filters
from loomgrid.llm.text import as_bytes, squeeze, trim
from loomgrid.operators.shared import checked, cut, fresh_dir

#: Rows and bytes of texts a memtable holds before it is flushed.
MEMTABLE_ROWS = 20_000
MEMTABLE_BYTES = 16 << 20
#: Ids one run of hits carries for a text, so that no row grows with its group.
IDS_PER_ROW = 4_096
NO_ID = (1 << 63) - 1


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _key(digest: bytes) -> int:
    """64 mixed bits of any digest, for the filter."""
    return int.from_bytes(hashlib.blake2b(digest, digest_size=8).digest(), "little", signed=True)


RUNS = "digest binary, least long, rows long"
INDEX = RUNS + ", part long, keys array<long>"
LOOKED = "digest binary, rep long, ids array<long>, body binary, hit boolean"


def _flush_runs(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], bytes]) -> Iterator[pa.RecordBatch]:
    """Columns: id, text."""
    table: dict[bytes, list[int]] = {}

    def run() -> pa.RecordBatch:
        order = sorted(table)
        out = pa.RecordBatch.from_arrays([pa.array(order, pa.binary()), *(pa.array([table[d][k] for d in order], pa.int64()) for k in (0, 1))], names=["digest", "least", "rows"])
        table.clear()
        return out

    for batch in batches:
        for i, raw in zip(batch.column(0).fill_null(NO_ID).to_pylist(), as_bytes(batch.column(1)), strict=True):
            d = digest(squeeze(raw))
            if (entry := table.get(d)) is None:
                table[d] = [i, 1]
            else:
                entry[0], entry[1] = min(entry[0], i), entry[1] + 1
            if len(table) >= MEMTABLE_ROWS:
                yield run()
    if table:
        yield run()
    trim()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges sorted runs; gives the digests with more than one row, and now and then the filter keys of some of them."""
    keys: dict[int, list[int]] = {}
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["digest", "least", "rows", "part", "keys"])

    def merged() -> Iterator[tuple[bytes, int, int]]:
        last, least, n = None, 0, 0
        for batch in batches:
            for d, i, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d == last:
                    least, n = min(least, i), n + m
                    continue
                if n > 1:
                    yield last, least, n
                last, least, n = d, i, m
        if n > 1:
            yield last, least, n

    out = []
    for d, least, n in merged():
        key = _key(d)
        keys.setdefault(filters.part_of(key), []).append(key)
        out.append((d, least, n, None, None))
        if len(out) >= 10_000:
            yield rows(out + [(None, None, None, part, found) for part, found in keys.items()])
            out, keys = [], {}
    yield rows(out + [(None, None, None, part, found) for part, found in keys.items()])


def merge_index(docs: DataFrame, doc_id: str, text: str, digest: Callable[[bytes], bytes]) -> tuple[DataFrame, list]:
    """(digest, least, rows) of the digests that more than one row has, written, and the filters of its ranges."""
    runs = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(partial(_flush_runs, digest=digest), RUNS)
    merged = cut(runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merge_runs, INDEX))
    return merged.where("digest is not null").select("digest", "least", "rows"), filters.by_part(merged.where("digest is null").select("part", "keys"))


def _probe(batches: Iterator[pa.RecordBatch], table, digest) -> Iterator[pa.RecordBatch]:
    """Non-hits as rows of their own, hits as rows with one text a memtable. Columns: id, text."""
    memory: dict[bytes, list] = {}  # text -> [digest, ids]
    held = 0

    def rows(found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "rep", "ids", "body", "hit"])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        run = sorted((d, min(ids), body, sorted(ids)) for body, (d, ids) in memory.items())
        for start in range(0, len(run), 256):
            yield rows([(d, rep, ids, body, True) for d, rep, body, ids in run[start : start + 256]])
        held = 0
        memory.clear()

    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_pylist()
        texts = [squeeze(raw) for raw in as_bytes(batch.column(1))]
        digests = [digest(t) for t in texts]
        maybe = filters.might_hold_parts(table.value, np.array([_key(d) for d in digests], dtype=np.int64))
        yield rows([(d, i, [i], None, False) for d, i, m in zip(digests, ids, maybe, strict=True) if not m])
        for d, i, body, m in zip(digests, ids, texts, maybe, strict=True):
            if not m:
                continue
            if (entry := memory.get(body)) is None:
                memory[body] = [d, [i]]
                held += len(body) + 200
            else:
                entry[1].append(i)
                held += 8
            if held >= MEMTABLE_BYTES or len(memory.get(body, (0, ()))[1]) >= IDS_PER_ROW:
                yield from flush()
    yield from flush()
    trim()


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_digest (binary, of the text with squeezed white space)."""
    spark = docs.sparkSession
    index, found = merge_index(docs, doc_id, text, digest)
    table = spark.sparkContext.broadcast(found)
    path = fresh_dir(spark, "dedup-lookups")
    docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(partial(_probe, table=table, digest=digest), LOOKED).write.parquet(path)
    looked = spark.read.parquet(path)
    hits = looked.where("hit")
    texts = hits.groupBy("digest", "body").agg(F.min("rep").alias("least"), F.sum(F.size("ids")).alias("n"))
    several = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    several = cut(several)  # collisions
    n = several.count()
    rows = hits.select("digest", "rep", "ids", "body" if n else F.lit(None).cast("binary").alias("body"))
    alike = rows.join(checked(several, n), "digest", "left_anti").drop("body") if n else rows.drop("body")
    told = alike.join(index, "digest", "left").select("digest", F.lit("").alias("text"), "rep", "ids", F.coalesce("least", "rep").alias("keep"), F.coalesce("rows", F.lit(1).cast("long")).alias("n"))
    if n:
        own = texts.join(checked(several, n), "digest", "left_semi").select("digest", "body", F.col("least").alias("keep"), "n")
        told = told.unionAll(rows.join(own, ["digest", "body"]).select("digest", F.sha2("body", 256).alias("text"), "rep", "ids", "keep", "n"))
    # of rows with the smallest id, in one memtable or in several, the first is kept
    first = F.row_number().over(Window.partitionBy("digest", "text", "keep").orderBy(F.lit(0)))
    ends = told.where("rep = keep").withColumn("first", first == 1)
    rest = told.where("rep <> keep").withColumn("first", F.lit(False))
    each = ends.unionAll(rest).select("digest", "keep", "n", "first", F.posexplode("ids").alias("pos", "i"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    alone = looked.where("not hit").select(known("rep").alias("doc_id"), known("rep").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_digest"))
    return alone.unionAll(each.select(known("i").alias("doc_id"), known("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first") & (F.col("pos") == 0)).alias("kept"), F.col("digest").alias("text_digest")))


def _split(batches: Iterator[pa.RecordBatch], table, digest, hits: bool, id_at: int, text_at: int) -> Iterator[pa.RecordBatch]:
    """Whole rows that the filter rules out, or the possible hits with digest, id and text in front; of equal texts in a memtable the smallest id goes on."""
    def take(batch):
        texts = [squeeze(raw) for raw in as_bytes(batch.column(text_at))]
        digests = [digest(t) for t in texts]
        return texts, digests, filters.might_hold_parts(table.value, np.array([_key(d) for d in digests], dtype=np.int64))

    for batch in batches:
        texts, digests, maybe = take(batch)
        if not hits:
            yield batch.filter(pa.array(~maybe))
            continue
        best: dict[bytes, tuple] = {}
        for row, (t, m) in enumerate(zip(texts, maybe, strict=True)):
            if m:
                i = batch.column(id_at)[row].as_py()
                at = (NO_ID if i is None else i, row)
                if t not in best or at < best[t]:
                    best[t] = at
        rows = sorted((digests[row], i, row) for i, row in best.values())
        if rows:
            front = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())]
            kept = batch.take(pa.array([r[2] for r in rows]))
            yield pa.RecordBatch.from_arrays(front + kept.columns, names=["digest__", "id__", *kept.schema.names])
    trim()


def _first_of_each(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    now, seen = None, set()
    for batch in batches:
        keep = []
        for row, (d, raw) in enumerate(zip(batch.column(0).to_pylist(), as_bytes(batch.column(text_at + 2)), strict=True)):
            if d != now:
                now, seen = d, set()
            if (t := squeeze(raw)) not in seen:
                seen.add(t)
                keep.append(row)
        yield pa.RecordBatch.from_arrays(batch.take(pa.array(keep, pa.int64())).columns[2:], names=batch.schema.names[2:])


def dedup_keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """The rows of docs with all their columns, of each group of equal texts the one with the smallest id. Only possible hits are shuffled."""
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(merge_index(docs, doc_id, text, digest)[1])
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # any names may clash with ours
    id_at, text_at = names.index(doc_id), names.index(text)
    plain = plain.withColumn(f"c{id_at}", F.col(f"c{id_at}").cast("long")) if dict(docs.dtypes)[doc_id] != "bigint" else plain
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(plain.schema.fields))
    common = {"table": bloom, "digest": digest, "id_at": id_at, "text_at": text_at}
    alone = plain.mapInArrow(partial(_split, hits=False, **common), schema)
    hits = plain.mapInArrow(partial(_split, hits=True, **common), f"digest__ binary, id__ long, {schema}")
    first = hits.repartition("digest__").sortWithinPartitions("digest__", "id__").mapInArrow(partial(_first_of_each, text_at=text_at), schema)
    return alone.unionAll(first).toDF(*names)
