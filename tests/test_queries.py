"""Every query runs, and equals its SQL."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from evenload import queries

ROOT = Path(__file__).resolve().parents[1]
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, matches, name):
    df = queries.QUERIES[name](spark, DIR)
    if name in queries.ORACLES:
        matches(df, queries.ORACLES[name])
    else:
        assert df.columns and df.count() > 0


def test_size_code_adds_in_the_order_of_the_table(spark, tmp_path):
    # 2^53 + 1 + 1 is 2^53 one by one, and 2 more if the ones are added first; so are the cents of customer 2, around 1.
    files = {
        "part-10": [(1, 2.0**53), (2, 0.3), (3, None), (None, 7.5)],
        "part-9": [(1, 1.0), (1, 1.0), (2, 0.6), (2, 0.1), (3, 2.5), (4, None), (None, 1.5)],
    }
    (tmp_path / "orders.parquet").mkdir()
    con = duckdb.connect(config={"threads": 1})
    for name, terms in files.items():
        con.execute("create or replace table t (o_custkey bigint, o_totalprice double)")
        con.executemany("insert into t values (?, ?)", terms)
        con.sql(f"copy t to '{tmp_path}/orders.parquet/{name}.parquet' (format parquet)")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    key = lambda r: [(v is None, v or 0) for v in r]
    want = sorted(con.sql(queries.ORACLES["size_code"]).fetchall(), key=key)
    for most in ("1", "128m"):  # a task for each file, or one for both
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = queries.QUERIES["size_code"](spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((tuple(r) for r in got), key=key) == want


def test_plans_even_out(spark):
    for strategy in ("first_fit", "best_fit", "minmax"):
        got = queries.QUERIES[f"{strategy}_balance"](spark, DIR).collect()
        assert sum(r.hashed for r in got) == pytest.approx(sum(r.planned for r in got))
        assert max(r.planned for r in got) < max(r.hashed for r in got)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_corpus_operators(tmp_path):
    for name in ("evenload", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "evenload/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "evenload").rglob("*.py"):
        if "llm" not in path.parts:
            assert "evenload.llm" not in path.read_text()
