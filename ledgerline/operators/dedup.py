"""First-wins deduplication in stages, with a ledger of row counts and an audit of what was removed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the rows of one key are ranked.
SALTS = 256


def numbered(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str], name: str = "_rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``.  Spark cuts each key to one row before the shuffle (rank limit), so hot keys stay small."""
    return numbered(df, key, order).where("_rn = 1").drop("_rn")


def removed_rows(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The rows that ``keep_first`` drops, with their place in ``dup_rank``."""
    return numbered(df, key, order, "dup_rank").where("dup_rank > 1")


@dataclass
class Stage:
    """Either a key (rows without it pass) or a condition to keep rows by."""

    name: str
    key: Column | None = None
    keep: Column | None = None
    note: str = ""


@dataclass
class DedupPipeline:
    """Stages in order over rows whose priority is ``order``.

    ``run`` returns what is kept, what was removed with its stage, and the ledger (stage, rows_in,
    rows_out, removed, note).  Each stage adds one marking column to the rows it saw, so the three results
    share one plan; the ledger is one aggregation over the marks.

    A key that very many rows share is ranked in SALTS parts first; the firsts of the parts are then ranked
    among themselves, and rows that lost within their part stay spread.  Rows travel as they are given: give
    lengths and hashes rather than texts.
    """

    stages: Sequence[Stage]
    order: Sequence[Column | str]

    def mark(self, df: DataFrame) -> DataFrame:
        """``df`` with ``removed_by``: the stage that removed the row, or null."""
        out = df.withColumn("removed_by", F.lit(None).cast("string"))
        for i, stage in enumerate(self.stages):
            alive = F.col("removed_by").isNull()
            if stage.key is not None:
                out = out.withColumn("_key", F.when(alive, stage.key))
                # Rows without a key are spread by a salt of their own, so they make no hot group.
                own = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
                out = out.withColumn("_salt", F.when(F.col("_key").isNull(), own).otherwise(F.pmod(own, F.lit(SALTS))))
                rank = lambda salt: F.row_number().over(Window.partitionBy("_key", salt).orderBy(*self.order))
                out = out.withColumn("_part", rank(F.col("_salt")))
                out = out.withColumn("_rank", rank(F.when((F.col("_part") > 1) | F.col("_key").isNull(), F.col("_salt"))))
                lost = alive & F.col("_key").isNotNull() & ((F.col("_part") > 1) | (F.col("_rank") > 1))
                out = out.withColumn("removed_by", F.when(lost, stage.name).otherwise(F.col("removed_by"))).drop("_key", "_salt", "_part", "_rank")
            else:
                out = out.withColumn("removed_by", F.when(alive & ~F.coalesce(stage.keep, F.lit(False)), stage.name).otherwise(F.col("removed_by")))
        return out

    def ledger(self, marked: DataFrame) -> DataFrame:
        counts = marked.agg(F.count("*").alias("n"), *(F.count_if(F.col("removed_by") == s.name).alias(f"r{i}") for i, s in enumerate(self.stages)))
        before = lambda i: reduce(lambda a, b: a - b, (F.col(f"r{k}") for k in range(i)), F.col("n"))
        rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(s.name).alias("stage"), before(i).alias("rows_in"), before(i + 1).alias("rows_out"), F.col(f"r{i}").alias("removed"), F.lit(s.note).alias("note")) for i, s in enumerate(self.stages)]
        return counts.select(F.inline(F.array(*rows)))

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        marked = self.mark(df)
        return marked.where("removed_by is null").drop("removed_by"), marked.where("removed_by is not null"), self.ledger(marked)
