"""One Spark session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = Path(os.environ.get("TREELAKE_DATA", "/root/testdata"))
SF = os.environ.get("TREELAKE_SF", "sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoint")
        .config("spark.sql.warehouse.dir", f"file://{folder}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{folder}/checkpoint")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(DATA / SF)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{file}/*.parquet" if file.is_dir() else str(file)
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{source}')")
    return connection


def plain(value):
    """A value that compares equal across engines: floats rounded, containers as tuples."""
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, float)):
        return plain(float(value))
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    """Rows with columns in order of their names, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="session")
def compared(spark, duck, sf_dir):
    """A function that asserts that a query gives the rows of its SQL."""

    def compare(query, sql: str) -> None:
        df = query(spark, sf_dir)
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        found, wanted = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
        assert len(found) == len(wanted) > 0
        assert found == wanted

    return compare
