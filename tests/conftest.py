"""A Spark session for all tests, and DuckDB views of the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, dict):
        return str({k: _plain(v) for k, v in value.items()})
    if isinstance(value, list | tuple):
        return str([_plain(v) for v in value])
    return repr(value) if isinstance(value, float) else str(value)


def same_rows(df, sql: str, folder: str) -> None:
    """df has the rows and columns of the SQL over the tables of a folder, in any order."""
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    rel = duck(folder).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want
