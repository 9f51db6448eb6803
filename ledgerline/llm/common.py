"""What the operators share: tables, scratch tables in the shared folder, worker-wide caches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.scratch import LOCAL_SCRATCH, WRITTEN, cut, discard, scratch  # noqa: F401

#: Spark's own sizes of the batches that travel to Python workers, and those set in their place.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder.  Batches are made smaller where the session has Spark's defaults: memory, not results, depends on them."""
    for key, (default, smaller) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, smaller)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cached(key: str, make: Callable[[], Any], most: int = 3) -> Any:
    """One object per Python process: worker processes outlive tasks, functions sent by value don't.

    The ``most`` objects used last stay; others make room, so stages that follow each other in one
    process don't add up.
    """
    store = sys.__dict__.setdefault("_ledgerline_cached", {})
    store[key] = found = store.pop(key) if key in store else make()
    while len(store) > most:
        store.pop(next(iter(store)))
    return found


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Bloom:
    """A fixed 8 MB filter of ids: always true for those in it, rarely true for others.

    It only saves work before an exact join.  Its size is fixed, so it may travel to every task whatever
    the size of the table behind it; with very many ids it lets more through, never less.
    """

    WORDS, HASHES = 1 << 20, 4

    def __init__(self, ids: DataFrame, column: str = "id") -> None:
        spot = F.xxhash64(column, F.col("_k"))
        spots = ids.select(column, F.explode(F.sequence(F.lit(0), F.lit(self.HASHES - 1))).alias("_k")).select(spot.alias("h"))
        word, bit = F.pmod(F.shiftright("h", 6), F.lit(self.WORDS)), F.expr("shiftleft(1L, cast(h & 63 as int))")
        words = spots.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        bits = np.zeros(self.WORDS, np.int64)
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    def spots(self, column: str = "id") -> Column:
        """The hashes that ``passed`` wants, as an array column."""
        return F.array(*(F.xxhash64(column, F.lit(k)) for k in range(self.HASHES)))

    def passed(self, spots: pa.Array) -> np.ndarray:
        h = spots.flatten().to_numpy().reshape(-1, self.HASHES)
        return ((self.bits.value[(h >> 6) % self.WORDS] >> (h & 63)) & 1).all(axis=1)
