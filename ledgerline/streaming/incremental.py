"""Resumable work: by ids already in the sink, by a lookup cache, and as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.ranks import ordered


def new_rows(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the sink yet."""
    return df.join(done.select(*key).distinct(), list(key), "left_anti")


def retryable(df: DataFrame, status: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose status begins with one of the prefixes."""
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | F.coalesce(F.col(status).startswith(p), F.lit(False))
    return df.where(fits)


def with_cache(df: DataFrame, cache: DataFrame, key: str, value: str, look_up: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``value`` by key from a cache table; misses go through ``look_up`` once per distinct key.

    Returns the enriched rows and the additions to the cache.
    """
    misses = df.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    fresh = look_up(misses).select(key, value)
    both = cache.select(key, value).unionByName(fresh)
    return df.drop(value).join(both, key, "left"), fresh


def checkpointed_counts(df: DataFrame, number: str, every: int) -> DataFrame:
    """(checkpoint, rows, done): progress after every ``every`` rows."""
    per = df.groupBy(F.floor(F.col(number) / every).alias("checkpoint")).agg(F.count("*").alias("rows"))
    return ordered(per, "checkpoint", measure="rows").select("checkpoint", "rows", (F.col("_before") + F.col("rows")).alias("done"))


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda d: d):
    """New files of ``source`` into a Parquet sink, each key once, and stop.

    Each micro-batch drops its own repeats and what the sink has (anti join); the stream's checkpoint
    remembers the files, so a stopped run goes on where it ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = transform(batch).dropDuplicates(list(key))
        try:
            done = spark.read.parquet(sink)
        except Exception as error:  # the sink has nothing yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        else:
            fresh = new_rows(fresh, done, key)
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, time: str, by: Sequence[str], measure: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window, with a watermark; works on streams and on tables."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(measure).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def distinct_stream(events: DataFrame, time: str, key: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key once while its state is kept."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))
