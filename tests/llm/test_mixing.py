import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgrid.llm.mixing import budgets, mix, share, words


def test_shortages_go_to_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = budgets(supply, {("a",): 1, ("b",): 1}, 400, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    got = budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, {}, 400, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 370}
    assert sum(budgets({("a",): 5, ("b",): 5}, {}, 400, 2).values()) == 20
    assert budgets({("a",): 50, ("b",): 50}, {("b",): 0}, 80, 1) == {("a",): 50, ("b",): 0}


def test_share_sums_up():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 6)
        wants, most = [rng.choice([0, 1, 2.5]) for _ in range(n)], [rng.randint(0, 50) for _ in range(n)]
        budget = rng.randint(0, 200)
        got = share(budget, wants, most)
        room = sum(m for m, w in zip(most, wants) if w)
        assert abs(sum(got) - min(budget, room)) < 1e-6
        assert all(g <= m + 1e-9 for g, m in zip(got, most))


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 9))), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2"])) for i in range(n)]


@pytest.mark.parametrize(("part", "epochs"), [(0.5, 1), (1.0, 3), (2.3, 3)])
def test_prefixes_are_brute_force(spark, part, epochs):
    made = rows()
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(5)
    weights = {("en",): 3.0, ("de",): 1.0, (None, "s0"): 2.0}
    got = mix(df, {"lang": F.col("lang"), "source": F.col("source")}, weights, share_of_supply=part, epochs=epochs).collect()
    hashes = {(e, r.doc_id): r.h for e in range(epochs + 1) for r in df.select("doc_id", F.xxhash64(F.lit(42), F.lit(e).cast("long"), "doc_id").alias("h")).collect()}
    leaves = defaultdict(list)
    for i, t, lang, source in made:
        leaves[lang, source].append((i, len(t.split())))
    given = budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, weights, part * sum(len(t.split()) for _, t, _, _ in made), epochs)
    expected = []
    for leaf, docs in leaves.items():
        supply = sum(n for _, n in docs)
        whole, rest = divmod(given[leaf], supply)
        expected += [(i, e) for e in range(whole) for i, _ in docs]
        total = 0
        for i, n in sorted(docs, key=lambda d: hashes[whole, d[0]]) if rest else []:
            total += n
            if total > rest:
                break
            expected.append((i, whole))
    assert sorted((r.doc_id, r.epoch__) for r in got) == sorted(expected)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", "en"), (1, None, "en"), (1, "c", None), (1, "c", None)], "doc_id long, text string, tokens string")
    got = mix(df, {"l": F.col("tokens")}, {}, share_of_supply=1.0)
    assert got.columns[:3] == df.columns
    assert got.count() == 4
    assert mix(df.limit(0), {"l": F.col("tokens")}, {}).count() == 0
    assert mix(df, {"l": F.col("tokens")}, {}, budget=0).count() == 0
    with pytest.raises(ValueError):
        mix(df, {"l": F.col("tokens")}, {("en",): -1.0}).count()
    with pytest.raises(ValueError):
        mix(df, {"l": F.col("tokens")}, {}, most_leaves=1)


def test_columns_that_are_called_like_the_added_ones(spark):
    df = spark.createDataFrame([(1, "a b", "en", 7, 8, 9)], "doc_id long, text string, lang string, epoch__ int, TOKENS__ int, budget__ int")
    got = mix(df, {"l": F.col("lang")}, {}, share_of_supply=1.0)
    assert got.columns == [*df.columns, "epoch___", "tokens___", "budget___"]
    assert [tuple(r)[3:] for r in got.select(*df.columns, "tokens___").collect()] == [(7, 8, 9, 2)]


def test_scripts_without_spaces_count_by_sign(spark):
    made = [("两个黄鹂鸣翠柳", 7), ("ab 两c个 d", 5), ("スパークは速い。", 8), ("ภาษา x", 5), ("don't stop\tnow", 3), ("한국어 문장", 2), ("", 0), (None, 0), (" \n", 0)]
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in enumerate(made)], "doc_id long, text string, n long")
    assert [(r.n, r.got) for r in df.select("n", words().alias("got")).collect()] == [(n, n) for _, n in made]


def test_a_leaf_without_spaces_gets_its_weight(spark):
    made = [(k, "字" * 50, "zh") for k in range(40)] + [(100 + k, "word " * 50, "en") for k in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r.lang: r.n for r in mix(df, {"lang": F.col("lang")}, {}, share_of_supply=0.5).groupBy("lang").agg(F.sum("tokens__").alias("n")).collect()}
    assert got == {"zh": 1000, "en": 1000}
