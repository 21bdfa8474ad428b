"""SimHash near-dedup: fingerprints, linked within a Hamming radius by BK-trees, and the components of the links.

Fingerprints are dealt to shards; every shard of more than one becomes a BK-tree, whose nodes hang under their parents by
integer Hamming distance, and searches follow only edges within the radius. A shard's tree goes only to the task that holds
the shard's rows: a broadcast of all trees would grow with the corpus.

components() is exact. Two 64-bit fingerprints within `radius` bits agree on at least fields - radius of `fields` bit fields;
each choice of fields - radius fields is a sharding. Six fields and radius 4 give 15 shardings of 21 or 22 bits each, seven
give 35 of 27 or 28 bits for more than 2**27 different fingerprints. From each tree only a forest of links leaves the task.

near_dedup_keep() asks for a Jaccard similarity of sets of shingles. There a shard agrees on ROWS least hashes of the set under
seeded permutations, for each of BANDS groups of them, so a document has BANDS rows whatever the size of the corpus, and a
shard holds documents that share much of their text. The shard's BK-tree finds candidates by one word of the set's fingerprint;
further words and the sizes of the sets thin them out, and only the exact Jaccard similarity of two sets (of 64-bit hashes)
makes a link. First each document has its few nearest candidates compared, which joins most groups. Documents of which some
candidate was left out then meet again, with their sets, in those shards where they aren't all joined yet: there the task
compares each two candidates that nothing joins, and gives only the forest of the links. So every candidate is either joined or
compared, and no group of copies makes all its pairs as rows.

A shard of more than SHARD rows is first cut into pieces by a hash, each a tree of its own, for as long as that still finds
links. Then only the rows outside the shard's largest component are left to be compared with all of its rows, in pieces too:
no link is lost, and a group with a third of all rows costs its rows once a round, not their square.

Null and blank texts have fingerprint zero, which links like any other. Rows with a null id get the component of their
fingerprint. Repeated rows and ties change nothing; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.text import as_bytes, trim
from loomgrid.operators.components import connected_components
from loomgrid.operators.shared import checked, cut, without

SEED = 42
#: Most rows of a shard that go into one tree, and that search one.
SHARD = 4_096
#: Fields of the fingerprint up to this many different fingerprints; one more beyond.
FIELDS, FIELDS_UP_TO = 6, 1 << 27
#: Shardings by least hashes, and the hashes that a shard agrees on: 99.96 % of the pairs of similarity 0.8 share one.
BANDS, ROWS = 20, 5
PROPOSED = 2  # candidates that a document has compared before its sets go to the shards
HEAVY = 2_048  # shingles that make a set count as a row of a shard, and as two if it has twice as many
_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def hashes(raw: bytes, width: int) -> list[int]:
    """XXH64 of every shingle of `width` words, repeats included; of all words, if fewer; none without words."""
    words = raw.lower().split()  # on bytes: A-Z only, and white space as in text.SPACES
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
    return [h(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def majority(found: list[int] | np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint's 64-bit words: a bit is set if it is set in over half the hashes. Further words mix each hash anew."""
    ones = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, len(found), _CHUNK):
        part = np.array(found[k : k + _CHUNK], dtype="<u8")[:, None]
        if words > 1:
            part = np.concatenate([part, *(_mix(part, n) for n in range(1, words))], axis=1)
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view("<u8") if len(found) else np.zeros(words, dtype=np.uint64)


def _mix(h: np.ndarray, n: int) -> np.ndarray:
    """Another well mixed 64-bit hash of a hash: a multiplication, a fold and a second multiplication."""
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) ^ h) * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return np.unique(np.array(hashes(raw, width), dtype="<u8"))


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band: a hash of the least of the set's hashes under each of the band's permutations."""
    n = np.arange(1, bands * rows + 1, dtype=np.uint64)[:, None]
    shift, factor = _mix(n, 1), _mix(n, 2) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(found), 1024):
        np.minimum(least, ((found[None, k : k + 1024] ^ shift) * factor).min(axis=1), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for k, part in enumerate(least.reshape(bands, rows).T):
        key = _mix(key ^ part, k)
    return key


def _sketches(batches: Iterator[pa.RecordBatch], width: int, words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Of the set of shingles: a digest, the size, the fingerprint's words and the key of each band; rows without words are left out."""
    for batch in batches:
        sets = [shingle_set(raw, width) for raw in as_bytes(batch.column(1))]
        at = [k for k, found in enumerate(sets) if len(found)]
        prints = np.array([majority(sets[k], words) for k in at], dtype=np.uint64).reshape(-1, words).view(np.int64)
        digests = pa.array([xxhash.xxh3_128_digest(sets[k].tobytes()) for k in at], pa.binary())
        keys = pa.array([band_keys(sets[k], bands, rows).view(np.int64) for k in at], pa.list_(pa.int64()))
        sizes = pa.array([len(sets[k]) for k in at], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), digests, sizes, keys, *(pa.array(np.ascontiguousarray(prints[:, n])) for n in range(words))], names=["doc_id", "digest", "size", "keys", *_words(words)])
    trim()


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([majority(hashes(raw, width), words) for raw in as_bytes(batch.column(1))], dtype=np.uint64).reshape(-1, words).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(prints[:, n])) for n in range(words))], names=["doc_id", *_words(words)])
    trim()


def _words(n: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, n))]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, words: int = 1) -> DataFrame:
    """(doc_id long, fp long, fp1 long, ...): the fingerprint of each row, as signed longs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(partial(_fingerprints, width=width, words=words), "doc_id long, " + ", ".join(f"{w} long" for w in _words(words)))


def shardings(radius: int, fields: int) -> list[int]:
    """Masks of the bits that the members of a shard agree on."""
    bounds = [round(64 * k / fields) for k in range(fields + 1)]
    field = [((1 << bounds[k + 1]) - 1) ^ ((1 << bounds[k]) - 1) for k in range(fields)]
    return [sum(field[k] for k in chosen) for chosen in combinations(range(fields), fields - radius)]


class BKTree:
    """Each node holds the rows of one value; its children hang under it by their integer Hamming distance to that value."""

    built = walked = 0  # trees grown and nodes searched in this process, for tests

    def __init__(self, values: np.ndarray):
        BKTree.built += 1
        self.values = values
        self.top: tuple[np.ndarray, dict] | None = None
        todo: list[tuple[np.ndarray, dict | None, int]] = [(np.arange(len(values)), None, 0)] if len(values) else []
        while todo:
            at, above, edge = todo.pop()
            d = np.bitwise_count(values[at] ^ values[at[0]])
            node: tuple[np.ndarray, dict] = (at[d == 0], {})
            todo += [(at[d == e], node[1], e) for e in set(d.tolist()) if e]
            if above is None:
                self.top = node
            else:
                above[edge] = node

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of values and of the queries within the radius of them, in one walk for all queries."""
        todo = [(self.top, np.arange(len(queries)))] if self.top else []
        while todo:
            (own, below), at = todo.pop()
            BKTree.walked += 1
            d = np.bitwise_count(queries[at] ^ self.values[own[0]]).astype(np.int64)
            hit = at[d <= radius]
            if len(hit):
                yield np.repeat(own, len(hit)), np.tile(hit, len(own))
            for e, node in below.items():
                on = at[np.abs(d - e) <= radius]
                if len(on):
                    todo.append((node, on))


class Forest:
    """Union-find that keeps the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _link(prints: np.ndarray, tree: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """A label for each row of prints, equal for rows that links between the tree's rows and the queries' join."""
    label = np.arange(len(prints))
    for v, q in BKTree(prints[tree]).near(prints[queries], radius):
        a, b = tree[v], queries[q]
        while len(at := np.flatnonzero(label[a] != label[b])):
            a, b = a[at], b[at]
            x, y = label[a[0]], label[b[0]]
            label[label == max(x, y)] = min(x, y)
    return label


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """The columns of each shard or piece of more than one row, the rows of its tree and those that search it. Rows (key, tag,
    node, ...) are sorted by key and tag. The tag holds the piece and, as its last bit, the side: rows of side 0 build the tree,
    those of side 1 search it; without a side 1 the tree's own rows do."""

    def shard(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        tree, searches = np.flatnonzero(columns[1] % 2 == 0), np.flatnonzero(columns[1] % 2 == 1)
        return columns, tree, searches if len(searches) else tree

    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        key, group = columns[0], columns[1] // 2
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1])) + 1).tolist()]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                yield shard([c[s:e] for c in columns])
        rest = [c[bounds[-1] :] for c in columns]
    if rest is not None and len(rest[0]) > 1:
        yield shard(rest)


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, tag, node, label, fp) as in _shards(). Gives the forest of all links in the partition."""
    forest = Forest()
    for columns, tree, searches in _shards(batches):
        node = columns[2].tolist()
        label = _link(columns[4].view(np.uint64), tree, searches, radius)
        for k in np.flatnonzero(label != np.arange(len(label))).tolist():
            forest.join(node[k], node[label[k]])
    members = list(forest.up)
    for k in range(0, len(members), 10_000):
        part = members[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, [forest.root(m) for m in part])], names=["src", "dst"])
    trim()


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The pairs (a, b) of rows with their distance, and which of them are among the `most` nearest of their b; ties go by a hash of the pair."""
    mixed = _mix(node[a] ^ node[b], 3)
    order = np.lexsort((mixed, apart, b))
    a, b, apart = a[order], b[order], apart[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    return a, b, apart, rank < most


CANDIDATES = "src long, dst long, apart long"


def _shard_candidates(batches: Iterator[pa.RecordBatch], radius: int, bits: int, most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, tag, node, label, size, fingerprint words) as in _shards(). Gives (src, dst, apart): to each node src its `most`
    nearest candidates dst of other labels in each shard; and (node, null, null) for either node of each pair left out."""
    pairs: dict[tuple[int, int], int] = {}
    left_out: set[int] = set()

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], names=["src", "dst", "apart"])

    for columns, tree, searches in _shards(batches):
        node, label, size = columns[2], columns[3], columns[4]
        if label.min() == label.max():
            continue
        prints = np.stack([c.view(np.uint64) for c in columns[5:]], axis=1)
        grown = BKTree(prints[tree, 0])
        for k in range(0, len(searches), 512):
            part = searches[k : k + 512]
            found: list[tuple[np.ndarray, ...]] = []
            for v, q in grown.near(prints[part, 0], radius):
                a, b = tree[v], part[q]
                ok = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) * (1 - 1e-9))
                a, b = a[ok], b[ok]
                if len(a):
                    apart = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
                    ok = apart <= bits
                    found.append((a[ok], b[ok], apart[ok]))
            if not found:
                continue
            a, b, apart, ok = _nearest(*(np.concatenate(x) for x in zip(*found, strict=True)), node.view(np.uint64), most)
            if not len(a):
                continue
            pairs.update(zip(zip(node[b[ok]].tolist(), node[a[ok]].tolist(), strict=True), apart[ok].tolist(), strict=True))
            left_out.update(node[np.unique(np.concatenate([a[~ok], b[~ok]]))].tolist())
        if len(pairs) > 200_000:
            yield from out([(*p, n) for p, n in pairs.items()])
            pairs.clear()
    yield from out([*((*p, n) for p, n in pairs.items()), *((n, None, None) for n in left_out)])
    trim()


class Sets:
    """Sets of hashes of some rows, with the share that one of them has in common with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        known, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(known), dtype=bool)

    def _own(self, n: int) -> np.ndarray:
        return self.at[self.starts[n] : self.starts[n + 1]]

    def jaccard(self, one: int, others: np.ndarray) -> np.ndarray:
        self.mark[self._own(one)] = True
        shared = self.mark[np.concatenate([self._own(n) for n in others])]
        self.mark[self._own(one)] = False
        both = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]]), dtype=np.int64)
        return both / (self.sizes[one] + self.sizes[others] - both)


def _shard_confirmed(batches: Iterator[pa.RecordBatch], radius: int, bits: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, tag, node, label, size, keys, shingles, fingerprint words) as in _shards(). Gives the forest of the partition's
    links: candidates of different labels, compared exactly in the first shard they share, unless links have joined them already."""
    forest = Forest()
    for columns, tree, searches in _shards(batches):
        key, node, label, size = columns[0][0], columns[2], columns[3].copy(), columns[4]
        if label.min() == label.max():
            continue
        bands = np.stack(columns[5])
        prints = np.stack([c.view(np.uint64) for c in columns[7:]], axis=1)
        sets = Sets([np.frombuffer(raw, dtype="<u8") for raw in columns[6]])
        grown = BKTree(prints[tree, 0])
        for k in range(0, len(searches), 256):
            part = searches[k : k + 256]
            found: list[tuple[np.ndarray, ...]] = []
            for v, q in grown.near(prints[part, 0], radius):
                a, b = tree[v], part[q]
                ok = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) * (1 - 1e-9))
                a, b = a[ok], b[ok]
                if len(a):
                    apart = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
                    ok = apart <= bits
                    found.append((a[ok], b[ok], apart[ok]))
            if not found:
                continue
            a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            same = bands[a] == bands[b]
            ok = bands[a, same.argmax(axis=1)] == key  # else another shard compares them
            a, b, apart = a[ok], b[ok], apart[ok]
            order = np.lexsort((apart, b))
            a, b = a[order], b[order]
            starts = [*np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist(), len(b)] if len(b) else []
            for s, e in zip(starts, starts[1:], strict=False):
                one, rest = b[s], a[s:e]
                while len(rest := rest[label[rest] != label[one]]):
                    near, rest = rest[:64], rest[64:]
                    for other in near[sets.jaccard(one, near) >= similarity]:
                        if label[other] != label[one]:
                            forest.join(int(node[one]), int(node[other]))
                            label[label == label[other]] = label[one]
    members = list(forest.up)
    for k in range(0, len(members), 10_000):
        part = members[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, [forest.root(m) for m in part])], names=["src", "dst"])
    trim()


def _large(rows: DataFrame, count: int) -> DataFrame | None:
    """(key, n) of the shards beyond SHARD, if there are any, in two steps: hashes of keys that few rows share can't hold one,
    and only the rest is counted by key, so that the usual case costs no shuffle of a row a shard."""
    if count <= SHARD:
        return None
    bins = 1 << max(10, (count // 256).bit_length())
    binned = rows.select("key", F.xxhash64("key").bitwiseAND(F.lit(bins - 1)).alias("bin"))
    full = cut(binned.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("bin"))
    if not (n := full.count()):
        return None
    large = cut(binned.join(checked(full, n), "bin", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
    return None if large.isEmpty() else large


def _pieces(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """Rows (key, tag, node, ...) by shard; large shards in pieces by a hash."""
    if large is None:
        tagged = rows.withColumn("tag", F.lit(0).cast("long"))
    else:
        some = rows.join(checked(large, large.count()), "key", "left")
        own = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") * 1.25 / SHARD))
        tagged = some.withColumn("tag", F.coalesce(own, F.lit(0)).cast("long") * 2).drop("n")
    return _ordered(tagged.select("key", "tag", *rows.columns[1:]))


def _ordered(tagged: DataFrame) -> DataFrame:
    return tagged.repartition("key", F.expr("tag div 2")).sortWithinPartitions("key", "tag")


def _all_in(rows: DataFrame, large: DataFrame | None, weight: Column | None = None) -> DataFrame:
    """Rows (key, tag, node, ...) by shard, in which each two rows of different labels of a shard meet. In a large shard the rows
    outside its largest label build the trees, in pieces, and all its rows search them. weight: what a row takes of a piece."""
    if large is None:
        return _pieces(rows, None)
    told = checked(large, large.count())
    labels = rows.join(told, "key").groupBy("key", "label").agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))
    shares = labels.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    split = cut(shares.select("key", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / SHARD).alias("trees"), F.ceil(F.col("n") / SHARD).alias("searches")).where("trees > 0"))
    some = rows.join(checked(split, split.count()), "key")
    own = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    trees = some.where("label <> top").withColumn("tag", F.explode(F.transform(upto("searches"), lambda j: (own("trees") * F.col("searches") + j) * 2)))
    searches = some.withColumn("tag", F.explode(F.transform(upto("trees"), lambda i: (i * F.col("searches") + own("searches")) * 2 + 1)))
    names = ["key", "tag", *rows.columns[1:]]
    small = rows.join(told, "key", "left_anti").withColumn("tag", F.lit(0).cast("long"))
    return _ordered(small.select(*names).unionAll(trees.select(*names)).unionAll(searches.select(*names)))


def links(prints: DataFrame, radius: int, fields: int, count: int | None = None) -> DataFrame:
    """prints: (node, fp), one row a fingerprint. Returns (src, dst): links between nodes that join just what all links within
    the radius join."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in shardings(radius, fields)]
    # A shard's key is a hash of what its members agree on. Two shards with one hash would only be searched as one.
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))
    rows = prints.select(F.explode(keys).alias("key"), "node", F.col("node").alias("label"), "fp")
    large = _large(rows, (prints.count() if count is None else count) * len(masks))
    work = partial(_shard_links, radius=radius)
    first = _pieces(rows, large).mapInArrow(work, "src long, dst long")
    if large is None:
        return first
    first = cut(first)
    component = connected_components(first)
    hot = rows.drop("label").join(checked(large, large.count()), "key", "left_semi")
    labelled = hot.join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"), "fp")
    return first.unionAll(_all_in(labelled, large).mapInArrow(work, "src long, dst long"))


SETS = "node long, digest binary, shingles binary"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(raw, width).tobytes() for raw in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (map(xxhash.xxh3_128_digest, sets), sets))], names=["node", "digest", "shingles"])
    trim()


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (src, dst, set, set) the pairs whose sets have the similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) * (1 - 1e-9):
                keep.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both / (len(x) + len(y) - both) >= similarity)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))
    trim()


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of pairs (src, dst) of ids those whose shingle sets have the Jaccard similarity, exactly. texts: (doc_id, t)."""
    wanted = cut(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct())
    sets = cut(texts.join(checked(wanted, wanted.count()), "doc_id", "left_semi").select("doc_id", "t").mapInArrow(partial(_sets, width=width), SETS).drop("digest"))
    a, b = sets.alias("a"), sets.alias("b")
    both = pairs.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).select("src", "dst", F.col("a.shingles").alias("x"), F.col("b.shingles").alias("y"))
    return both.mapInArrow(partial(_alike, similarity=similarity), "src long, dst long")


def _links_of_rest(texts: DataFrame, rest: DataFrame, width: int, bounds: dict) -> DataFrame | None:
    """Links (src, dst) that join what all confirmed candidates among rest (node, digest, label, size, keys, fingerprint words) join; none,
    if no shard has several labels."""
    weight = F.ceil(F.col("size") / HEAVY)
    dealt = rest.select(F.explode("keys").alias("key"), "node", "digest", "label", "size")
    several = cut(dealt.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(weight).cast("long").alias("n")).where("low < high").select("key", "n"))
    if not (count := several.count()):
        return None
    rows = cut(dealt.join(checked(several, count), "key", "left_semi").select("key", "node", "digest"))
    wanted = cut(rows.select("node").distinct())
    sets = texts.join(checked(wanted, wanted.count()), F.col("doc_id") == F.col("node"), "left_semi").select("doc_id", "t").mapInArrow(partial(_sets, width=width), SETS)
    whole = cut(rest.join(sets.dropDuplicates(["node", "digest"]), ["node", "digest"]))  # an id can have several texts
    names = [c for c in rest.columns if c not in ("node", "digest", "label", "size", "keys")]
    shards = rows.join(whole, ["node", "digest"]).select("key", "node", "label", "size", "keys", "shingles", *names)
    large = cut(several.where(F.col("n") > SHARD))
    met = _all_in(shards, None if large.isEmpty() else large, weight)
    return cut(met.mapInArrow(partial(_shard_confirmed, **bounds), "src long, dst long"))


def components(prints: DataFrame, radius: int = 4, fields: int | None = None) -> DataFrame:
    """prints: (doc_id, fp), one row per document. Returns doc_id, fp, component_id (the smallest id that links reach)."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    count = classes.count()
    if fields is None:
        fields = FIELDS if count <= FIELDS_UP_TO else FIELDS + 1
    joined = connected_components(links(classes.select(F.col("fp").alias("node"), "fp"), radius, max(fields, radius + 1), count=count))
    roots = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def bits_apart(similarity: float, bits: int, spread: float = 1.0) -> int:
    """Bits in which two fingerprints of sets with this Jaccard similarity differ, and `spread` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, words: int = 2, spread: float = 3.5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, component_id) of the documents that share a component with a smaller id. Rows with one id are one document; rows
    without an id or without words link to none. Every link is of the similarity or more."""
    names = _words(words)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where("doc_id is not null")
    made = partial(_sketches, width=width, words=words, bands=bands, rows=rows)
    sketches = cut(texts.mapInArrow(made, "doc_id long, digest binary, size long, keys array<long>, " + ", ".join(f"{w} long" for w in names)))
    of_equal = F.min(F.struct("doc_id", "size", "keys", *names)).alias("s")
    classes = cut(sketches.groupBy("digest").agg(of_equal).select("digest", F.col("s.doc_id").alias("node"), "s.size", "s.keys", *(f"s.{w}" for w in names)))
    bounds = {"radius": bits_apart(similarity, 64, spread), "bits": bits_apart(similarity, 64 * words, spread), "similarity": similarity}
    shards = classes.select(F.explode("keys").alias("key"), "node", F.col("node").alias("label"), "size", *names)
    large = _large(shards, classes.count() * bands)
    found = cut(_pieces(shards, large).mapInArrow(partial(_shard_candidates, most=PROPOSED, **bounds), CANDIDATES))
    pairs = found.where("dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "apart", F.col("src").alias("by")).distinct()
    nearest = F.row_number().over(Window.partitionBy("by").orderBy("apart", F.xxhash64("src", "dst"), "src", "dst"))
    ranked = cut(pairs.withColumn("near", nearest <= PROPOSED))  # a document has at most that many candidates a shard
    first = cut(confirmed(texts, cut(ranked.where("near").select("src", "dst").distinct()), width, similarity))
    component = connected_components(first)
    over = [found.where("dst is null").select(F.col("src").alias("node")), ranked.where("not near").select(F.explode(F.array("src", "dst")).alias("node"))]
    if large is not None:  # whose pieces have not met each other
        over.append(shards.join(checked(large, large.count()), "key", "left_semi").select("node"))
    left_out = cut(reduce(DataFrame.unionAll, over).distinct())
    if not left_out.isEmpty():
        rest = cut(classes.join(left_out, "node", "left_semi").join(component, "node", "left").select("node", "digest", F.coalesce("component", "node").alias("label"), "size", "keys", *names))
        more = _links_of_rest(texts, rest, width, bounds)
        if more is not None:
            component = connected_components(first.unionAll(more))
    roots = classes.join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    named = sketches.select("doc_id", "digest").join(roots, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return named.where("doc_id > component_id")


def near_dedup_keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs with all their columns, of each component of near copies the one with the smallest id."""
    return without(docs, near_copies(docs, doc_id, text, **options).select("doc_id"), doc_id)
