"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine (master ``local``) that names no checkpoint folder.
LOCAL_SCRATCH = "ledgerline-scratch"
#: Scratch tables that this process wrote.
WRITTEN: list[str] = []
#: Plan nodes that give the same rows, to the last bit, whenever they run.
STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "Range"}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (base or f"{tempfile.gettempdir()}/{LOCAL_SCRATCH}").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, lost executors cost nothing."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str) -> DataFrame:
    """``df``, written first unless it only picks from stored rows.

    A sum of doubles depends on the order in which a shuffle delivers its parts: computed twice, it may differ in the last
    bits, and what joins the two by value loses rows.
    """

    def steady(node) -> bool:
        children = node.children()
        return node.nodeName() in STEADY and node.deterministic() and all(steady(children.apply(i)) for i in range(children.size()))

    return df if steady(df._jdf.queryExecution().optimizedPlan()) else cut(df, name)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables of this process written from number ``since`` on, but for the last ``keep``.

    Results that still read them must be written before.
    """
    end = len(WRITTEN) - keep
    gone, WRITTEN[since:end] = WRITTEN[since:end], []
    for made in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
