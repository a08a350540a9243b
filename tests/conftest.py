"""One Spark session, the smallest tables, and DuckDB views over them."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file if file.is_file() else file / '*.parquet'}'")
    return con


def plain(value: object) -> object:
    """Values of both engines in one form."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and a query have the same columns and rows."""

    def compare(df, sql: str) -> None:
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())

    return compare
