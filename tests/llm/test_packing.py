import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgrid.llm.packing import cuts, deal, difference, pack
from loomgrid.llm.vocabulary import byte_bpe, default_path, encode

TEXTS = ["", "hello <|endoftext|> world", "  spaces\t\n and  é😀 中文 \u0000", "don't 123 I'LL ﬁ", "a" * 5000, " ".join(f"word{i}" for i in range(3000)), "<|endoftext|>"]


def test_ids_are_those_of_tokenizers():
    ours, theirs = byte_bpe(default_path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    signs = "abc ABC\n\t'é中😀1.,<|endoftext|>-_"
    for text in TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(300)]:
        assert encode(ours, text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_difference_is_a_partition():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 120))]
        windows = difference(sizes, k)
        assert len(windows) == max(k, 1)
        assert sorted(n for w in windows for n in w) == list(range(len(sizes)))
        if len(sizes) > 8 * k:
            sums = [sum(sizes[n] for n in w) for w in windows]
            assert max(sums) - min(sums) <= 40


def test_capacity_raises_the_count():
    assert sorted(map(len, deal([600, 600, 600], 1024))) == [1, 1, 1]
    assert len(deal([512, 512, 512, 512], 1024)) == 2


def test_round_trip(spark):
    rows = list(enumerate(TEXTS * 5)) + [(None, "no id"), (3, TEXTS[3]), (99, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    got = pack(df).toPandas()
    encoding = byte_bpe(default_path("byte_bpe_50k.tiktoken"))
    whole = {i: [*encode(encoding, t or "").tolist(), 0] for i, t in rows}
    for i, own in got.dropna(subset="doc_id").groupby("doc_id"):
        copies = sum(x == i for x, _ in rows)
        if copies == 1:
            own = own.sort_values("start")
            assert [x for b in own.ids for x in np.frombuffer(b, "<u4").tolist()] == whole[i]
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
            assert set(own.doc_tokens) == {len(whole[i])}
        else:
            assert own.length.sum() == copies * len(whole[i])
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 1024
    assert got.length.sum() == sum(len(whole[i]) for i, _ in rows)


def test_little_padding(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 60, 200, 700])))) for i in range(1500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).groupBy("sequence_id").sum("length").toPandas()
    sums = got["sum(length)"]
    padding = sum(1024 - n for n in sums if n & (n - 1))
    assert padding < 0.02 * sums.sum()


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def naive(sizes, k):
    """Karmarkar-Karp with all k sums written out: the two widest partial partitions are merged, fullest with emptiest."""
    parts = [(n, [s] + [0] * (k - 1)) for n, s in enumerate(sizes)]
    n = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0] - p[1][-1]), p[0]))
        (_, a), (_, b), *rest = parts
        n += 1
        parts = [*rest, (n, sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))]
    return parts[0][1]


def test_difference_is_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        k, sizes = rng.randint(2, 9), [rng.choice([1024, 700, rng.randint(1, 256)]) for _ in range(rng.randint(1, 40))]
        assert sorted(sum(sizes[n] for n in w) for w in difference(sizes, k)) == sorted(naive(sizes, k))


def test_every_piece_is_dealt_by_differencing(spark, monkeypatch):
    from loomgrid.llm import packing

    dealt = []
    monkeypatch.setattr(packing, "deal", lambda sizes, capacity: dealt.append(sum(sizes)) or deal(sizes, capacity))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([" ".join(f"w{i}" for i in range(9000)), "short"])], names=["doc_id", "t"])
    out = list(packing._pack(iter([batch]), default_path("byte_bpe_50k.tiktoken"), 1024, 256, 16, 0))
    assert sum(dealt) == sum(sum(b.column(2).to_pylist()) for b in out) > 20_000


def test_only_what_has_no_room_is_cut():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.choice([1024, rng.randint(1, 1023), rng.randint(1, 200)]) for _ in range(rng.randint(1, 200))]
        parts = cuts(sizes, 1024)
        assert [sum(p) for p in parts] == sizes and all(min(p) > 0 and len(p) <= 2 for p in parts)
        assert all(len(p) == 1 for p, s in zip(parts, sizes, strict=True) if s == 1024)
    assert cuts([600, 400, 24], 1024) == [[600], [400], [24]]
    assert cuts([], 1024) == []


def test_documents_are_not_shredded(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 450)))) for i in range(2500)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    sums = got.groupby("sequence_id").length.sum()
    assert len(got) <= 2 * len(rows)
    assert sum(1024 - n for n in sums if n & (n - 1)) < 0.02 * sums.sum()
