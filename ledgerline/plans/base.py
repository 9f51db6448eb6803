"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read on demand: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def scratch(self, name: str) -> str:
        """A path of its own in the folder of ``spark.checkpoint.dir``; a session on one machine without one uses a temporary folder."""
        context = self.spark.sparkContext
        base = self.spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        return f"{(base or tempfile.gettempdir() + '/ledgerline-scratch').rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return register
