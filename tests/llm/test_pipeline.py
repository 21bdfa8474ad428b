"""The pipeline's stages against brute force on planted documents, and the queries with SQL against it."""

import os
import random
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from loomgrid.llm import queries

DATA = "/root/testdata/sf0.001"


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "ro", "vi") for b in ("ren", "sol", "tik", "dan", "mor", "lis")]
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    docs, junk, exact, near = [], set(), {}, {}
    add = lambda text: docs.append((len(docs), text, rng.choice(["en", "de", "fr"]), f"src{rng.randrange(3)}")) or len(docs) - 1
    for _ in range(150):
        add(good(rng.randint(60, 200)))
    for _ in range(40):
        junk.add(add(" ".join(f"{rng.choice(vocabulary)}***" for _ in range(80))))
    for k in range(20):
        exact[add(docs[k][1].replace(" ", "  "))] = k
    for k in range(20, 40):
        words = docs[k][1].split()
        words[len(words) // 2] = "changed"
        near[add(" ".join(words))] = k
    labels = [(i, int(i not in junk), 0) for i in range(190) if rng.random() < 0.6]
    return docs, labels, junk, exact, near


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels, *rest = planted()
    df = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/out{k}")
        now = spark.read.parquet(f"{folder}/out{k}")
        out.append(now)
    return folder, df, out, rest


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, run):
    folder, df, out, (junk, exact, near) = run
    assert [s.columns for s in out[:4]] == [df.columns] * 4
    everything = ids(df)
    kept = ids(out[0])
    assert not kept & junk and len(everything - junk - kept) <= 2
    texts = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in out[0].collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert ids(out[1]) == set(first.values())
    left = ids(out[2])
    assert left <= ids(out[1]) and sum(i not in left for i in near if i in kept) >= 0.9 * len(near)
    assert all(i in left for i in ids(out[1]) if i not in near)
    tokens = lambda d: sum(len(r.text.split()) for r in d.collect())
    assert 0.8 * tokens(out[2]) <= tokens(out[3]) <= 0.9 * tokens(out[2])
    assert out[3].count() == len(ids(out[3])) and ids(out[3]) <= left
    packed = out[4].toPandas()
    assert set(packed.doc_id) == ids(out[3])
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_run_is_the_stages(spark, run):
    folder, _, out, _ = run
    key = lambda d: sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in d.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(out[4])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, expected = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    tidy = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    plain = lambda d: sorted((tuple(map(tidy, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=str)
    assert sorted(got.columns) == sorted(expected.columns) and plain(got) == plain(expected)


def test_every_query_has_its_columns(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    wanted = {
        "op1": ["query_id", "rank", "vec_id", "score"], "op3": ["page_id", "url", "text", "n_chars"], "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op8": ["doc_id", "fingerprint", "component_id"], "op10": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for name, f in queries.queries().items():
        expected = wanted.get(name.split("_")[0])
        if expected:
            assert f(spark, DATA).columns[: len(expected)] == expected
