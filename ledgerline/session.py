"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ledgerline", **conf: str) -> SparkSession:
    """AQE on, UTC, ANSI as Spark ships it.  Give ``master`` or any ``spark.*`` key with dots as underscores doubled."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
