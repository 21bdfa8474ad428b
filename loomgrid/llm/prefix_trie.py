"""The trie of conversations by their turns, by partition refinement.

All conversations begin as one class, that of the empty prefix. Each round splits the active classes by the next turn, and every
class is a node: its conversations begin with the same turns. Equal conversations are one sequence with a weight, so a class of one
sequence has nothing left to split: it retires and emits its tail as a chain of single children. What the nodes count is then
folded back from the leaves to the root.

Classes of up to `local` turns are split to their end, and folded, within a task each; larger classes are split by a round of
joins and aggregations over all of them at once, so no group is gathered beyond that bound. A retired sequence is not
gathered either: its turns go by from the last to the first. Rounds are as many as the turns that a class above the bound
shares. A turn is known by the SHA-256 of role and text; texts are not shuffled. The ids of equal conversations are hashed in
pieces of 4096, and go by one after another.

Defined cases: turns go by number, null first, then by role and digest. Null role and text are empty. Rows of a null conv_id
take no part. A conversation without turns is a member of the root alone. Repeated rows are turns like others. Other
columns play no part; an empty table has no conversations, so it gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.hot import meet
from loomgrid.operators.shared import Rounds, cut, delete, fresh_dir

LOCAL = 1 << 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_digest binary"
NOBODY = hashlib.sha256(b"").hexdigest()
#: A class: its least member, depth, that of the class it was split from, members, sequences, turns still to come, and its last turn.
CLASS = "class long, depth long, parent long, n_convs long, sequences long, ahead long, chars long, ends string, digest binary"


def compact(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): the turns of each conversation numbered from 0, without their texts."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(told("role")), F.lit(":"), told("role"), told("text")), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), digest.alias("digest"), F.char_length(told("text")).cast("long").alias("chars")).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")) - 1
    return rows.select("conv_id", place.cast("long").alias("place"), "digest", "chars")


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """compact() rows of every conversation c rebuilt from the first h of conversation c - c % 100 and its own after the first h, where h is
    crc32(decimal c) % 6; and all conversations (conv_id), as some have no turns then."""
    rows = cut(rows)
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"))
    lent = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    convs = cut(convs.join(lent, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")))
    first = rows.where("place < 5").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    borrowed = convs.join(first, "base").where("place < h").select("conv_id", "place", "digest", "chars")
    own = rows.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    return borrowed.unionAll(own), convs.select("conv_id")


# ---- equal conversations


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns, sequence) from rows (conv_id, digest) in order."""
    now, running, n = None, None, 0
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["conv_id", "turns", "sequence"])

    for batch in batches:
        for conv, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if conv != now:
                if now is not None:
                    rows.append((now, n, running.digest()))
                now, running, n = conv, hashlib.sha256(), 0
            if digest is not None:
                running.update(digest)
                n += 1
        yield out()
    if now is not None:
        rows.append((now, n, running.digest()))
    yield out()


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """(rep, first, ids) from rows (rep, conv_id) in order: the ids of a sequence joined by commas, up to `size` in a piece."""
    for batch in batches:
        reps, ids = (batch.column(n).to_numpy() for n in (0, 1))
        if not len(reps):
            continue
        ends = np.flatnonzero(np.diff(reps)) + 1
        bounds = [0, *ends.tolist(), len(reps)]
        cuts = [(a, min(a + size, e)) for s, e in zip(bounds, bounds[1:]) for a in range(s, e, size)]
        told = [",".join(map(str, ids[a:b].tolist())) for a, b in cuts]
        yield pa.RecordBatch.from_arrays([pa.array([int(reps[a]) for a, _ in cuts], pa.int64()), pa.array([int(ids[a]) for a, _ in cuts], pa.int64()), pa.array(told, pa.string())], names=["rep", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ends) from the pieces in order."""
    now, running = None, None
    rows: list[tuple] = []
    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rep != now:
                if now is not None:
                    rows.append((now, running.hexdigest()))
                now, running = rep, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if now is not None:
        rows.append((now, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["rep", "ends"])


def _representatives(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(rep, turns, weight, ends): the least of equal conversations, how many they are, and the hash of their ids."""
    marked = rows.select("conv_id", "place", "digest").unionByName(convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest")))
    stream = marked.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest")
    known = cut(stream.mapInArrow(_sequence, "conv_id long, turns long, sequence binary"))
    groups = cut(known.groupBy("sequence").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.first("turns").alias("turns")))
    several = groups.where("weight > 1").select("sequence", "rep", "weight")
    members = meet(known.select("sequence", "conv_id"), several, ["sequence"], "weight", known.count())
    pieces = members.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_pieces, "rep long, first long, ids string")
    hashed = pieces.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(_hashed, "rep long, ends string")
    single = F.sha2(F.col("rep").cast("string"), 256)
    return groups.join(hashed, "rep", "left").select("rep", "turns", "weight", F.coalesce("ends", single).alias("ends"))


# ---- refinement


class _Nodes:
    """Rows of NODES on their way out of a task."""

    def __init__(self):
        self.rows: list[tuple] = []

    def out(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        columns = list(zip(*self.rows, strict=True)) or [()] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])


def refine(top: tuple, turns: dict[int, list[tuple]]) -> list[tuple]:
    """Rows of NODES for the class `top` (id, depth, parent, n_convs, chars, ends, digest) and all below it. turns: for each of
    its sequences the turns to come as (digest, chars, weight, ends), the next first."""
    ident, depth, parent, n_convs, chars, ends, digest = top
    nodes = [[ident, depth, parent, n_convs, 0, 0, (n_convs - 1) * chars, ends, digest]]
    above = [-1]
    active = [(0, [r for r, own in turns.items() if own], 0)]  # node, sequences that go on, turns taken

    def add(of: int, turn: tuple, rep: int, weight: int, ends: str) -> int:
        nodes[of][4] += 1
        nodes.append([rep, nodes[of][1] + 1, nodes[of][0], weight, 0, 0, (weight - 1) * turn[1], ends, turn[0]])
        above.append(of)
        return len(nodes) - 1

    while active:
        split = []
        for node, reps, k in active:
            if len(reps) == 1:  # retires: its tail is a chain
                for turn in turns[reps[0]][k:]:
                    node = add(node, turn, reps[0], turn[2], turn[3] or NOBODY)
                continue
            parts: dict[bytes, list[int]] = {}
            for r in reps:
                parts.setdefault(turns[r][k][0], []).append(r)
            for own in parts.values():
                firsts = [turns[r][k] for r in own]
                ended = next((f[3] for f, r in zip(firsts, own, strict=True) if len(turns[r]) == k + 1), None)
                child = add(node, firsts[0], min(own), sum(f[2] for f in firsts), ended or NOBODY)
                on = [r for r in own if len(turns[r]) > k + 1]
                if on:
                    split.append((child, on, k + 1))
        active = split
    for n in range(len(nodes) - 1, -1, -1):  # children come after their parents
        nodes[n][5] = nodes[n][5] or 1
        if n:
            nodes[above[n]][5] += nodes[n][5]
            nodes[above[n]][6] += nodes[n][6]
    return [tuple(n) for n in nodes]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODES of whole classes. A class is a row with rep null, then its sequences' turns, each sequence from the last turn to the first.
    A class of one sequence passes by turn for turn; others are gathered, as they have at most `local` turns."""
    nodes = _Nodes()
    top: tuple = ()
    turns: dict[int, list[tuple]] = {}
    single, chain, saved = False, 0, 0

    def end() -> None:
        if not top:
            return
        if single:
            ident, depth, parent, n_convs, chars, ends, digest = top
            nodes.rows.append((ident, depth, parent, n_convs, min(chain, 1), 1, saved + (n_convs - 1) * chars, ends, digest))
        else:
            nodes.rows.extend(refine(top, {r: own[::-1] for r, own in turns.items()}))

    for batch in batches:
        for ident, rep, depth, digest, chars, weight, ends, parent, sequences in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rep is None:
                end()
                top, turns, single, chain, saved = (ident, depth, parent, weight, chars, ends, digest), {}, sequences == 1, 0, 0
            elif single:
                saved += (weight - 1) * chars
                nodes.rows.append((rep, depth, ident if depth == top[1] + 1 else rep, weight, min(chain, 1), 1, saved, ends or NOBODY, digest))
                chain += 1
            else:
                turns.setdefault(rep, []).append((digest, chars, weight, ends))
            if len(nodes.rows) >= 8192:
                yield nodes.out()
        yield nodes.out()
    end()
    yield nodes.out()


def _class(groups: DataFrame, depth: int) -> DataFrame:
    return groups.withColumn("depth", F.lit(depth).cast("long")).select(*(c.split()[0] for c in CLASS.split(", ")))


def prefix_trie(rows: DataFrame, convs: DataFrame | None = None, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (of the
    subtree: all members of a node but one save its last turn), ends_sha256 (of the members that end there) and turn_digest.
    rows as of compact(); convs (conv_id) names conversations that may have no rows."""
    spark = rows.sparkSession
    rows = cut(rows)
    convs = rows.select("conv_id").distinct() if convs is None else convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").unionAll(rows.select("conv_id")).distinct()
    reps = cut(_representatives(rows, convs))
    whole = reps.agg(F.min("rep").alias("class"), F.sum("weight").alias("n_convs"), F.count("*").alias("sequences"), F.sum("turns").alias("ahead"), F.max(F.when(F.col("turns") == 0, F.col("ends"))).alias("ends")).first()
    if whole["class"] is None:
        return spark.createDataFrame([], NODES)

    # the turns of active sequences: class, rep, depth, digest, chars, weight, ahead (turns after this one), ends (of the last turn)
    state = rows.join(reps.withColumnRenamed("rep", "conv_id"), "conv_id").select(
        F.lit(whole["class"]).cast("long").alias("class"), F.col("conv_id").alias("rep"), (F.col("place") + 1).alias("depth"), "digest", "chars", "weight", (F.col("turns") - F.col("place") - 1).alias("ahead"), F.when(F.col("turns") == F.col("place") + 1, F.col("ends")).alias("ends")
    )
    folder = fresh_dir(spark, "trie")
    top = spark.createDataFrame([(whole["class"], 0, None, whole["n_convs"], whole["sequences"], whole["ahead"], 0, whole["ends"] or NOBODY, None)], CLASS)
    small = (F.col("sequences") == 1) | (F.col("ahead") <= local)
    heads, tails, large = f"{folder}/heads", f"{folder}/tails", f"{folder}/large"
    top.where(small).write.parquet(heads)
    top.where(~small).write.parquet(f"{large}/at=0")
    shape = state.limit(0)
    depth, active = 0, 0 if whole["sequences"] == 1 or whole["ahead"] <= local else whole["sequences"]
    if not active:
        state.write.parquet(tails)
    rounds = Rounds(spark, "trie-round")
    while active:
        now = rounds.put(state) if not depth else state
        depth += 1
        next_turns = now.where(F.col("depth") == depth)
        groups = next_turns.groupBy("class", "digest").agg(F.min("rep").alias("child"), F.sum("weight").alias("n_convs"), F.count("*").alias("sequences"), F.sum("ahead").alias("ahead"), F.first("chars").alias("chars"), F.coalesce(F.max("ends"), F.lit(NOBODY)).alias("ends"))
        groups = cut(groups)
        made = cut(_class(groups.select(F.col("child").alias("class"), F.col("class").alias("parent"), "n_convs", "sequences", "ahead", "chars", "ends", "digest"), depth))
        made.where(small).write.mode("append").parquet(heads)
        made.where(~small).write.parquet(f"{large}/at={depth}")
        total = groups.agg(F.sum("sequences")).first()[0]
        new = meet(next_turns.select("class", "digest", "rep"), groups.select("class", "digest", "child", "sequences", small.alias("done")), ["class", "digest"], "sequences", total).select("rep", "child", "done")
        dealt = rounds.put(now.where(F.col("depth") > depth).drop("class").join(new, "rep").withColumnRenamed("child", "class").select(*shape.columns, "done"))
        dealt.where("done").drop("done").write.mode("append").parquet(tails)
        state = dealt.where("not done").drop("done")
        active = made.where(~small).count()
    finished = _local(spark.read.schema(top.schema).parquet(heads), spark.read.schema(shape.schema).parquet(tails))
    nodes = _fold(spark, cut(finished), large, depth, top.schema) if depth else cut(finished)
    for path in (folder, rounds.path):
        delete(spark, path)
    return nodes


def _local(heads: DataFrame, tails: DataFrame) -> DataFrame:
    first = heads.select("class", F.lit(None).cast("long").alias("rep"), "depth", "digest", "chars", F.col("n_convs").alias("weight"), "ends", "parent", "sequences")
    rest = tails.select("class", "rep", "depth", "digest", "chars", "weight", "ends", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("sequences"))
    stream = first.unionAll(rest).repartition("class").sortWithinPartitions("class", F.col("rep").asc_nulls_first(), F.desc("depth"))
    return stream.mapInArrow(_finish, NODES)


def _fold(spark, finished: DataFrame, large: str, rounds: int, schema) -> DataFrame:
    """finished with the nodes that rounds of Spark split, the deepest first: what they count is the sum over their children."""
    done = f"{large}/folded"
    below = finished.where(F.lit(False))
    for depth in range(rounds - 1, -1, -1):
        kids = finished.where(F.col("depth") == depth + 1).unionAll(below).groupBy(F.col("parent_conv_id").alias("class")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        own = spark.read.schema(schema).parquet(f"{large}/at={depth}")
        folded = own.join(kids, "class").select(F.col("class").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", ((F.col("n_convs") - 1) * F.col("chars") + F.col("saved")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"), F.col("digest").alias("turn_digest"))
        below = cut(folded)
        below.write.mode("append").parquet(done)
    return cut(finished.unionAll(spark.read.schema(finished.schema).parquet(done)))


def with_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with the role and text of their last turn; the root has none."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(told("role")), F.lit(":"), told("role"), told("text")), 256))
    texts = turns.select(digest.alias("turn_digest"), told("role").alias("role"), told("text").alias("text")).dropDuplicates(["turn_digest"])
    return nodes.join(texts, "turn_digest", "left")
