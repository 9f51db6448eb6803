import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(folder))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def plain(value):
    """A value as both engines would print it."""
    import datetime
    import math

    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    try:
        number = float(value) if not isinstance(value, str) else None
    except TypeError:
        number = None
    if number is None:
        return value
    return None if math.isnan(number) else round(number, 5)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_as_sql(df, sql, folder=DATA):
    """Rows of a DataFrame and of DuckDB over the same tables."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    c.execute(sql)
    names = [d[0] for d in c.description]
    want = c.fetchall()
    assert sorted(df.columns) == sorted(names)
    return rows_of(df.columns, df.collect()), rows_of(names, want)
