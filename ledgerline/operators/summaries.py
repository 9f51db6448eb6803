"""Grouped summaries: counts, shares, coverage, breakdowns, bands and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import percent
from ledgerline.operators.ranks import ordered


def counted(df: DataFrame, keys: Sequence[str], entity: str | None = None, share: str | None = "share", within: Sequence[str] = ()) -> DataFrame:
    """Rows (or distinct entities: each counts once per key) and their share of the total, or of ``within``.

    Distinct counting drops duplicates before it counts, so the second aggregation sees one row per
    (key, entity).
    """
    counts = (df.select(*keys, entity).distinct() if entity else df).groupBy(*keys).agg(F.count(F.col(entity) if entity else F.lit(1)).alias("n"))
    if not share:
        return counts
    if within:
        return counts.withColumn(share, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn(share, F.col("n") / F.col("_total")).drop("_total")


def breakdown(df: DataFrame, group: str, measure: str, entity: str, low: float) -> DataFrame:
    """Per group: entities, how many stay under ``low``, total, mean, median, largest, coverage and concentration percent."""
    stats = df.groupBy(group).agg(
        F.countDistinct(entity).alias("entities"), F.sum(F.when(F.col(measure) < low, 1).otherwise(0)).alias("under"), F.sum(measure).alias("total"),
        F.avg(measure).alias("mean"), F.median(measure).alias("median"), F.max(measure).alias("largest"), F.count_if(F.col(measure) > 0).alias("covered"), F.count("*").alias("rows"),
    )
    return stats.withColumn("coverage_percent", percent("covered", "rows")).withColumn("concentration_percent", percent("largest", "total")).drop("covered", "rows")


def coverage(known: DataFrame, studied: DataFrame, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """Known and studied distinct keys per group, and the percentage; a known key counts as studied once."""
    marked = known.select(key, *groups).where(F.col(key).isNotNull()).distinct().join(studied.select(key).distinct().withColumn("_s", F.lit(1)), key, "left")
    out = marked.groupBy(*groups).agg(F.count("*").alias("known"), F.count("_s").alias("studied"))
    return out.withColumn("not_studied", F.col("known") - F.col("studied")).withColumn("coverage_percent", percent("studied", "known"))


def exclusive(df: DataFrame, item: str, condition: Column) -> DataFrame:
    """Items all of whose rows meet the condition, with their number of rows."""
    return df.groupBy(item).agg(F.bool_and(condition).alias("_all"), F.count("*").alias("n")).where("_all").drop("_all")


def flagged(df: DataFrame, key: str, condition: Column, every: str, some: str, none: str) -> DataFrame:
    """A label per key: all of its rows meet the condition, some do, none does."""
    return df.groupBy(key).agg(F.when(F.bool_and(condition), every).when(F.bool_or(condition), some).otherwise(none).alias("label"))


def joined_values(df: DataFrame, key: Sequence[str], value: str, separator: str = "; ") -> DataFrame:
    """Sorted distinct values of each key in one cell."""
    return df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias(value))


def latest(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of the row that is last by ``order``, per key: one aggregation, combined before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, F.struct(*order, value)).alias(value))


def modal(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest on a tie, with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), value))
    return counts.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def percentile_class(df: DataFrame, measure: str, classes: Sequence[tuple[float, str]], last: str, name: str = "bias_class") -> DataFrame:
    """The percent rank of ``measure`` over all rows, and its class; zero rows go to the first class.

    The rank of a value is the number of smaller rows: values are counted first, distinct ones put in order,
    and ranks joined back by value.
    """
    values = df.where(F.col(measure).isNotNull()).groupBy(measure).agg(F.count("*").alias("_n"))
    # One row: how many rows have a value.
    total = values.agg(F.sum("_n").alias("_all"))
    ranks = ordered(values, measure, measure="_n").crossJoin(F.broadcast(total)).select(measure, F.when(F.col("_all") > 1, F.col("_before") / (F.col("_all") - 1)).otherwise(0.0).alias("percentile"))
    chain = F.when(F.col("percentile").isNull(), F.lit(None).cast("string"))
    for edge, label in classes:
        chain = chain.when(F.col("percentile") < edge, label)
    return df.join(ranks, measure, "left").withColumn(name, chain.otherwise(last))


def quartiles(df: DataFrame, measure: str, key: str, by: Sequence[str] = (), n: int = 4) -> DataFrame:
    """``ntile`` groups: sizes differ by at most one, the larger first."""
    size, more = F.floor(F.col("_total") / n), F.col("_total") % n
    large = more * (size + 1)  # rows of the groups that hold one more
    tile = F.when(F.col("_place") <= large, F.ceil(F.col("_place") / (size + 1))).otherwise(more + F.ceil((F.col("_place") - large) / F.greatest(size, F.lit(1))))
    return ordered(df, measure, [key], by).withColumn("tile", tile.cast("int")).drop("_place", "_total", "_before")


def cut_quantiles(df: DataFrame, measure: str, key: str, by: Sequence[str] = (), n: int = 4) -> DataFrame:
    """Groups by linear quantile edges of the rank (ties by key), intervals closed on the right."""
    tile = F.lit(1)
    for i in range(1, n):
        tile = tile + F.when(F.col("_place") > 1 + i * (F.col("_total") - 1) / n, 1).otherwise(0)
    return ordered(df, measure, [key], by).withColumn("tile", tile).drop("_place", "_total", "_before")


def coverage_curve(counts: DataFrame, item: str, n: str = "n") -> DataFrame:
    """Items by falling count: place, running count and running share of the total."""
    out = ordered(counts, n, [item], measure=n, falling=True).withColumn("place", F.col("_place").cast("int")).withColumn("running", F.col("_before") + F.col(n))
    total = counts.agg(F.sum(n).alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("running_share", F.col("running") / F.col("_all")).drop("_all", "_place", "_total", "_before")


def rescaled(df: DataFrame, value: str, by: Sequence[str], name: str = "scaled") -> DataFrame:
    """Min-max scale per group; 0.5 where all values are equal, null stays null."""
    window = Window.partitionBy(*by)
    low, high = F.min(value).over(window), F.max(value).over(window)
    return df.withColumn(name, F.when(F.col(value).isNull(), F.lit(None)).when(high == low, 0.5).otherwise((F.col(value) - low) / (high - low)))


def top(df: DataFrame, k: int, n: str, item: str, by: Sequence[str] = (), ties: bool = False) -> DataFrame:
    """The ``k`` largest, per group; ``ties`` keeps all rows that tie with the last."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(F.desc(n))) if ties else F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(n), item))
    if not by and not ties:
        return df.orderBy(F.desc(n), item).limit(k)
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str], entity: str | None = None) -> DataFrame:
    """Counts as a matrix with one column per value, zeros filled, and the row total.

    The values are given, so the pivot needs no pass to find them.
    """
    base = df.select(row, column, entity).distinct() if entity else df
    wide = base.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))
    total = None
    for v in values:
        total = F.col(f"`{v}`") if total is None else total + F.col(f"`{v}`")
    return wide.withColumn("total", total)


def long(df: DataFrame, ids: Sequence[str], values: Sequence[str], names: tuple[str, str] = ("metric", "value")) -> DataFrame:
    return df.unpivot(list(ids), list(values), *names)


def first_by_pivot(df: DataFrame, row: str, column: str, values: Sequence[str], value: str, order: str) -> DataFrame:
    """One column per value of ``column`` with the first ``value`` by ``order``."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.min_by(value, order))


def missingness(df: DataFrame, columns: Sequence[str], na_tokens: Sequence[str] = ("",)) -> DataFrame:
    """Rows, missing values and their percentage per column: one pass over the table for all columns."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.lower(F.trim(c)).isin(*na_tokens) if kinds[c] == "string" else F.lit(False))
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(gone(c)).alias(f"_{i}") for i, c in enumerate(columns)))
    return one.select("rows", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(columns))))).withColumn("missing_percent", percent("missing", "rows"))


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all columns: one unpivot, one aggregation."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def run_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Calls, mean, median and 95th percentile (lower nearest rank) of a measure per stage; values are counted first."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col(value)))
    return ranked.groupBy(*by).agg(F.sum("_n").alias("calls"), (F.sum(F.col("_n") * F.col(value)) / F.sum("_n")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def grouped_sets(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Sums for every subset of the keys (cube); ``grouping_id`` tells them apart."""
    return df.cube(*keys).agg(F.grouping_id().alias("grouping_id"), F.sum(measure).alias("total"))
