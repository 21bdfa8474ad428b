import random
import re

import xxhash

from loomgrid.llm import simhash
from loomgrid.llm.simhash import bits_apart, components, fingerprints, near_copies, near_dedup_keep, shardings


def brute_print(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius):
    up = dict.fromkeys(prints)
    label = {i: i for i in up}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints(spark):
    rows = [(1, "The quick Brown fox\tjumps over the lazy dog"), (2, None), (3, "  "), (4, "two words"), (5, "É É é a b c d"), (6, "word " * 70_000)]
    got = {r.doc_id: r.fp % (1 << 64) for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {i: brute_print(t, 4) for i, t in rows}
    assert got[2] == got[3] == 0


def test_components_are_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    prints = {}
    for c in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            v = base
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.randrange(64)
            prints[len(prints)] = v
    prints[len(prints)] = 0
    prints[len(prints)] = 7
    monkeypatch.setattr(simhash, "SHARD", 30)  # pieces meet pieces
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, fp long").repartition(4)
    got = {r.doc_id: r.component_id for r in components(df, 4).collect()}
    assert got == brute_components(prints, 4)


def test_every_close_pair_shares_a_shard():
    rng = random.Random(1)
    masks = shardings(4, 6)
    assert len(masks) == 15
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_bk_tree_finds_all():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 30).astype(np.uint64)) for _ in range(40)]))
    tree = simhash.BKTree(values)
    found = {(int(a), int(b)) for v, q in tree.near(values, 4) for a, b in zip(v, q, strict=True)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}


def _copies():
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(30):
        base = words(300)
        for c in range(3):
            text = list(base)
            for _ in range(c * 3):
                text[rng.randrange(300)] = "changed"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
    for _ in range(60):
        groups[len(rows)] = 1000 + len(rows)
        rows.append((len(rows), " ".join(words(200))))
    return rows, groups


def test_near_copies(spark):
    rows, groups = _copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    assert all(groups[i] == groups[c] for i, c in gone.items())
    copies = [i for i, g in groups.items() if g < 1000 and i % 3]
    assert sum(i in gone for i in copies) >= 0.9 * len(copies)


def test_keep_edges(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (None, "a b c d e f", "x"), (3, None, "x"), (4, "", "x")]
    kept = near_dedup_keep(spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert near_dedup_keep(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert components(spark.createDataFrame([], "doc_id long, fp long")).count() == 0


def test_bits():
    assert bits_apart(0.8, 256, 0) == 38
    assert bits_apart(1.0, 256) == 0


def test_near_copies_are_of_the_similarity(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    shingles = lambda words: {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
    rows, alike = [], {}
    for k in range(300):
        one = fresh(404)
        goal = rng.uniform(0.6, 0.95)
        changed = round(400 * (1 - goal) / (1 + goal))
        other = one[:100] + fresh(changed - 4) + one[96 + changed :]
        a, b = shingles(one), shingles(other)
        alike[2 * k + 1] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
    crowd = fresh(404)  # copies of one document, each with a change of its own
    for k in range(1000, 1120):
        at = rng.randrange(400)
        rows.append((k, " ".join(crowd[:at] + fresh(1) + crowd[at + 1 :])))
    template = fresh(300)  # documents that share a passage and are no copies
    rows += [(k, " ".join(template + fresh(120))) for k in range(2000, 2040)]
    # what repeats in a document counts once: two clean documents with one long refrain
    rows += [(k, "la le li lo lu " * 400 + " ".join(fresh(60))) for k in (3000, 3001)]
    gone = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    planted = {i: c for i, c in gone.items() if i < 1000}
    assert all(c == i - 1 and alike[i] >= 0.8 for i, c in planted.items())
    near = [i for i, j in alike.items() if j >= 0.8]
    assert len(near) > 100 and sum(i in gone for i in near) >= 0.97 * len(near)
    assert all(gone.get(i) == 1000 for i in range(1001, 1120))
    assert not any(i >= 2000 for i in gone)


def test_trees_are_built_for_every_shard():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = []  # (key, tag, node, label, fp): 20 shards of two to six
    for key in range(20):
        for _ in range(2 + key % 5):
            rows.append((key, 0, len(rows), len(rows), int(rng.integers(0, 1 << 62))))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["key", "tag", "node", "label", "fp"])
    before = simhash.BKTree.built, simhash.BKTree.walked
    assert not list(simhash._shard_links(iter([batch]), 4))
    assert simhash.BKTree.built - before[0] == 20
    assert 20 <= simhash.BKTree.walked - before[1] <= len(rows)


def test_walks_follow_only_edges_within_the_radius():
    import numpy as np

    values = np.random.default_rng(8).integers(0, 1 << 63, 2000, dtype=np.uint64)
    before = simhash.BKTree.walked
    list(simhash.BKTree(values).near(values[:1], 4))
    assert simhash.BKTree.walked - before < 1000


def test_a_crowd_in_pieces_is_one_component(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):  # copies of one document with a change of their own, in shards far beyond SHARD
        at = rng.randrange(300)
        rows.append((k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])))
    rows += [(1000 + k, " ".join(f"y{k}-{n}" for n in range(100))) for k in range(50)]
    monkeypatch.setattr(simhash, "SHARD", 16)
    gone = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == dict.fromkeys(range(1, 150), 0)
