import hashlib
import random
import zlib

import duckdb
import pytest

from loomgrid.llm import prefix_trie as trie
from loomgrid.llm import queries as registered


def plain(rows):
    """All nodes from dictionaries of prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    for own in convs.values():
        own.sort()
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [(r[2], r[4]) for r in convs.get(c - c % 100, [])[:h] + own[h:]]
    return nodes_of(built)


def nodes_of(built):
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(own), len(prefix), parent, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def made(rng, n):
    texts = ["", "a", "né 中", None, "b" * 30]
    rows = []
    for c in rng.sample(range(1000), n):
        for turn in range(rng.randint(1, 8)):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "user", "assistant", None]), rng.choice(texts[: rng.choice([1, 2, 5])])))
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(r, n, t, c, 3) for c, n, r, t in rows], "role string, turn long, text string, conv_id long, depth int").repartition(parts)


def found(spark, rows, local):
    built, convs = trie.rebuild(trie.compact(frame(spark, rows)))
    return sorted((tuple(r)[:8] for r in trie.prefix_trie(built, convs, local).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("local", [0, 3, 40, trie.LOCAL])
def test_is_brute_force_with_any_bound(spark, local):
    rows = made(random.Random(local), 60)
    rows += [(2000 + c, n, "user", "same") for c in range(0, 700, 7) for n in range(3)] + [(None, 0, "user", "no id")]
    assert found(spark, rows, local) == plain(rows)


def test_turnless_conversations_meet_at_the_root(spark):
    lost = [c for c in range(100, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 1][:5]  # their bases are absent
    rows = [(c, 0, "user", "only") for c in lost]
    assert found(spark, rows, 0) == found(spark, rows, 99) == plain(rows)
    assert plain(rows)[0][3:6] == (5, 0, 1)


def test_repeats_and_empty(spark):
    rows = made(random.Random(1), 12)
    rows += rows[:20]
    assert found(spark, rows, 5) == plain(rows)
    none = frame(spark, rows).limit(0)
    built, convs = trie.rebuild(trie.compact(none))
    assert trie.prefix_trie(built, convs).count() == 0


def test_long_conversation_is_a_chain(spark):
    rows = [(7, n, "user", f"t{n}") for n in range(2500)] + [(8, 0, "user", "z" * 500_000)]
    nodes = trie.prefix_trie(trie.compact(frame(spark, rows)), local=10).collect()
    assert len(nodes) == 2502
    assert {(n.depth, n.n_children) for n in nodes if n.conv_id == 7 and n.depth} == {(d, int(d < 2500)) for d in range(1, 2501)}
    root = next(n for n in nodes if n.depth == 0)
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (2, 2, 2, 0)


def test_pieces_of_ids(spark):
    ids = list(range(0, 30_000, 2))
    rows = [(c, n, "user", "copy") for c in ids for n in range(2)]
    nodes = trie.prefix_trie(trie.compact(frame(spark, rows, 7))).collect()
    assert sorted(n.depth for n in nodes) == [0, 1, 2]
    deepest = max(nodes, key=lambda n: n.depth)
    assert deepest.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {n.n_convs for n in nodes} == {15_000}


def test_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi")]
    turns = frame(spark, rows)
    got = trie.with_texts(trie.prefix_trie(trie.compact(turns)), turns).collect()
    assert sorted((n.depth, n.role, n.text) for n in got if n.depth) == [(1, "user", "hi"), (2, "assistant", "")]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_its_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    rel = con.sql(registered.OP13_SQL)
    want = sorted(rel.fetchall(), key=str)
    got = registered.op13_prefix_trie(spark, data)
    assert set(got.columns) == set(rel.columns)
    assert sorted((tuple(r) for r in got.select(*rel.columns).collect()), key=str) == want
