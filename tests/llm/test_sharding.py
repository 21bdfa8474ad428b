import random
import zlib
from collections import Counter, defaultdict

import pytest

from loomgrid.llm import sharding
from loomgrid.llm.queries import queries


def plain(texts, shards):
    """LPT over whole groups with the smallest load looked up in a list."""
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    import hashlib

    loads, where = [0] * shards, {}
    for t, size in sorted(groups.items(), key=lambda g: (-g[1], hashlib.sha256(g[0].encode()).hexdigest())):
        s = loads.index(min(loads))
        loads[s] += size
        where[t] = s
    return where, loads


def made(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice("ab é中") for _ in range(rng.choice([0, 1, 3, 10, 200]))))
    return out + ["copy " * 30] * (n // 3) + ["x" * 40_000, None, "", None]


def check(got, rows, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
        assert 0 <= r["shard"] < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_is_a_plain_heap_on_few_groups(spark, shards):
    texts = made(random.Random(5), 120)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(t, 7, "s", i) for i, t in rows], "text string, size int, shard string, doc_id long").repartition(5)
    got = sharding.assign(df, shards).collect()
    check(got, rows, shards)
    where, _ = plain(texts, shards)
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r["shard"], r["size"], r.text_crc32) == (where[t], len(t.encode()) + 1, zlib.crc32(t.encode()))


def test_runs_of_small_groups_keep_balance_and_bound(spark):
    rng = random.Random(8)
    texts = made(rng, 6000)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keys = sharding.cut(sharding._keys(df, "doc_id", "text"))
    items = sharding._items(keys, 16)
    import math

    total = sum(len((t or "").encode()) + 1 for t in texts)
    groups = items.collect()
    assert len({g.item for g in groups}) <= 16 * math.log(total) + 1
    assert len({g.item for g in groups}) < len(groups)
    order = sorted(groups, key=lambda g: (-g.bytes, g.digest))
    assert [g.item for g in order] == sorted(g.item for g in groups)  # runs of neighbours
    got = sharding.assign(df, 8, resolution=16).collect()
    check(got, rows, 8)
    at = defaultdict(set)
    loads = Counter()
    for r in got:
        at[texts[r.doc_id] or ""].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in at.values())
    largest = max(plain(texts, 8)[1])
    assert max(loads.values()) <= max(largest, total / 8) * 1.001


def test_same_shards_on_other_partitions(spark):
    rows = list(enumerate(made(random.Random(3), 900)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r["shard"] for r in sharding.assign(df.repartition(n), 8, resolution=64).collect()} for n in (1, 7))
    assert one == two


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (1, ""), (2, "b" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, 8).collect()
    check(got, rows, 8)
    assert len({r["shard"] for r in got if r["size"] == 1}) == 1
    assert sharding.assign(df.limit(0), 8).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, 0)


def test_written_shards(spark, tmp_path):
    rows = [(i, t, i % 3) for i, t in enumerate(made(random.Random(1), 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)
    sharding.write_shards(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r["row"]) for r in back.collect()) == rows
    want = {r.doc_id: r["shard"] for r in sharding.assign(df, 4).collect()}
    assert {r.doc_id: r["shard"] for r in back.collect()} == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op11_lpt_sharding"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    where, loads = plain([d.text for d in docs], 8)
    texts = {d.doc_id: d.text for d in docs}
    assert len(got) == len(docs)
    assert all(r["shard"] == where[texts[r.doc_id] or ""] and r.law == "bytes" and r.grown_shard is None for r in got)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert sorted(sums.values()) == sorted(loads)
