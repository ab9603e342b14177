"""A local session, the driver's tables as DuckDB views, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1"}
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def medium() -> str:
    return str(TESTDATA / "sf0.01")


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    """A value that both engines give alike."""
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_bag(df: DataFrame) -> Counter:
    return bag(df.columns, df.collect())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> int:
    """df and the SQL over the same tables give the same columns and rows; returns how many."""
    con = views(sf_dir)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = bag(columns, result.fetchall()), spark_bag(df)
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{missing.total()} missing, e.g. {list(missing)[:2]}; {extra.total()} extra, e.g. {list(extra)[:2]}"
    return got.total()
