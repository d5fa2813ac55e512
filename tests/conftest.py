"""One session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, floats rounded, nulls alike."""

    def plain(v: object) -> object:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (float, int)) and not isinstance(v, bool):
            return round(float(v), 5)
        return v if isinstance(v, (bool, str)) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: [str(type(v)) + str(v) for v in r])


def same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """The DataFrame and the SQL give equal rows and names."""
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [
        (x, y)
        for x, y in zip(a, b, strict=True)
        if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 * max(1, abs(q))) for p, q in zip(x, y, strict=True))
    ]
    assert not wrong[:3]


@pytest.fixture
def matches(duck):
    return lambda df, sql: same(df, duck, sql)
