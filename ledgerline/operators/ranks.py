"""Places and running sums over a whole table, without a window that puts all of it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import SMALL, estimated_size

#: Ranges that a large table is dealt into.
PARTS = 512


def ordered(df: DataFrame, split: str, ties: Sequence[Column | str] = (), by: Sequence[str] = (), measure: str | None = None, falling: bool = False, limit: int | None = None) -> DataFrame:
    """``df`` with ``_place`` (from 1), ``_total`` rows, and ``_before``: the sum of ``measure`` (or the number of rows) before each row.

    Rows are ordered by the numeric column ``split`` (``falling``: largest first) and then by ``ties``, within ``by``.
    A table whose estimated size is under ``limit`` (SMALL by default), or one with ``by``, takes one window.
    A larger one is cut at approximate quantiles of ``split`` into ranges that are ordered on their own, and what
    lies before a range comes from one row per range.
    """
    order = [F.desc(split) if falling else F.col(split), *ties]
    value = F.col(measure) if measure else F.lit(1)
    if by or estimated_size(df) <= (SMALL if limit is None else limit):
        window = Window.partitionBy(*by).orderBy(*order)
        before = F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("_place", F.row_number().over(window)).withColumn("_before", before).withColumn("_total", F.count("*").over(Window.partitionBy(*by)))
    edges = df.agg(F.percentile_approx(split, [i / PARTS for i in range(1, PARTS)], 10 * PARTS)).first()[0] or []
    above = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>"), lambda e: e < F.col(split)))
    # Nulls stand before all values, or after them where the largest come first.
    part = F.when(F.col(split).isNull(), -1).otherwise(above)
    parted = df.withColumn("_part", -part if falling else part)
    sums = parted.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most PARTS + 1 rows.
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sums"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_places"), F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    window = Window.partitionBy("_part").orderBy(*order)
    own = parted.withColumn("_place", F.row_number().over(window)).withColumn("_before", F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = own.join(F.broadcast(starts), "_part")
    return joined.withColumn("_place", F.col("_place") + F.col("_places")).withColumn("_before", F.col("_before") + F.col("_sums")).drop("_part", "_sums", "_places")
