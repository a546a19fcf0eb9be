"""The driver's contract: every query of the engine gives what its SQL gives; the operators' package may be absent."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import brindle.queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_and_sql_agree(name, spark, sql):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = sql.sql(Q.ORACLES[name])
    assert sorted(theirs.columns) == columns
    place = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(r[i] for i in place)) for r in theirs.fetchall())


def test_entry_works_without_the_operators(tmp_path):
    root = Path(__file__).parent.parent
    for p in ("__spark_entry__.py", "brindle"):
        (tmp_path / p).symlink_to(root / p)
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *_):\n        if name in ('brindle.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert set(e.queries()) == set(e.oracle_sql()) and 'flagship' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_the_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_totalprice"]
