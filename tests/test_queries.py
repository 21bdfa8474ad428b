"""Every registered query against its SQL, and the driver's entry with and without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from loomgrid.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(df):
    columns = sorted(df.columns)
    tidy = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    rows = [tuple(tidy(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sql, name):
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(sql.sql(SQL[name]).df())


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
