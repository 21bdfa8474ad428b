import hashlib
import re
from collections import defaultdict

import pytest

from loomgrid.llm import exact_dedup
from loomgrid.llm.exact_dedup import dedup_keep, dedup_report

ROWS = [(7, "a b"), (3, "a \t\n b"), (5, "a b "), (None, "a b"), (9, None), (2, ""), (4, "x" * 300_000), (1, "x" * 300_000), (6, "unique"), (6, "unique"), (8, " "), (10, "\x0b"), (11, "a b")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def told(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.text_digest).hex()) for r in df.collect()], key=str)


def test_report_is_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert told(dedup_report(docs)) == brute(ROWS)


def weak(text):  # every digest collides
    return bytes([len(text) % 2])


def test_colliding_digests_do_not_join_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [(i, k, n, f) for i, k, n, f, _ in told(dedup_report(docs, digest=weak))]
    assert sorted(got, key=str) == sorted([r[:4] for r in brute(ROWS)], key=str)
    assert dedup_keep(docs, digest=weak).count() == sum(r[3] for r in brute(ROWS))


def test_small_memtables(spark, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(500)] + [(1000 + i, f"own {i}") for i in range(50)]
    monkeypatch.setattr(exact_dedup, "IDS_PER_ROW", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(dedup_report(docs)) == brute(rows)


def test_keep_has_all_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "m", i) for i, t in ROWS], "doc_id long, text string, digest__ string, c0 long").repartition(2)
    kept = dedup_keep(docs)
    assert kept.columns == docs.columns
    expected = sorted((r[0] for r in brute(ROWS) if r[3]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == expected
    assert all(r.c0 == r.doc_id and r.digest__ == "m" for r in kept.collect())


@pytest.mark.parametrize("f", [dedup_report, dedup_keep])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_keeps_smallest_ids_and_filters(spark):
    from loomgrid.llm import filters

    rows = [(i, f"text {i % 300}") for i in range(1000, 100, -1)] + [(5000 + i, f"own {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index, found = exact_dedup.merge_index(docs, "doc_id", "text", exact_dedup.sha256)
    told = {bytes(r.digest): (r.least, r.rows) for r in index.collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(t.encode()).digest()].append(i)
    assert told == {d: (min(g), len(g)) for d, g in groups.items() if len(g) > 1}
    import numpy as np

    held = filters.might_hold_parts(found, np.array([exact_dedup._key(d) for d in groups], dtype=np.int64))
    assert all(h for d, h in zip(groups, held, strict=True) if d in told)
    assert sum(held) - len(told) <= 40


def test_rows_without_ids_and_colliding_digests(spark):
    rows = [(None, "a"), (None, "a"), (None, "bcd"), (None, "bcd"), (1, "x"), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(i, k, n, f) for i, k, n, f, _ in told(dedup_report(docs, digest=weak))]
    assert sorted(got, key=str) == sorted([r[:4] for r in brute(rows)], key=str)
