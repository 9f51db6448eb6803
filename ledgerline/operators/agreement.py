"""Scoring and agreement: precision and recall, consensus, kappas."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import ratio
from ledgerline.operators.joins import small


def prf(truth: DataFrame, found: DataFrame, key: Sequence[str], by: Sequence[str] = (), partial: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per group, over sets of keys.

    ``partial``: groups (of ``by`` columns in it) whose truth is incomplete; their false positives don't count.
    """
    a = truth.select(*by, *key).distinct().withColumn("_t", F.lit(1))
    b = found.select(*by, *key).distinct().withColumn("_f", F.lit(1))
    both = a.join(b, [*by, *key], "full")
    counts_fp = F.lit(True)
    if partial is not None:
        on = [c for c in partial.columns if c in (*by, *key)]
        both = both.join(small(partial.select(*on).distinct().withColumn("_p", F.lit(1))), on, "left")
        counts_fp = F.col("_p").isNull()
    out = both.groupBy(*by).agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull() & counts_fp).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    out = out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def field_accuracy(truth: DataFrame, found: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per field: rows coded on both sides, share that agree, and coverage of the truth's rows."""
    a, b = truth.select(*key, *(F.col(f).alias(f"t_{f}") for f in fields)), found.select(*key, *(F.col(f).alias(f"f_{f}") for f in fields))
    rows = a.join(b, list(key), "left")
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").cast("string").alias("t"), F.col(f"f_{f}").cast("string").alias("f")) for f in fields))))
    both = F.col("t").isNotNull() & F.col("f").isNotNull()
    return long.groupBy("field").agg(F.count_if(F.col("t").isNotNull()).alias("coded"), F.count_if(both).alias("both"), F.avg(F.when(both, (F.lower("t") == F.lower("f")).cast("double"))).alias("accuracy")).withColumn("coverage", ratio("both", "coded"))


def consensus(df: DataFrame, item: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per item; ties go to the value seen first by ``order``.  With its votes, the raters, and whether it has a majority."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*item, value).agg(F.count("*").alias("votes"), F.min(order).alias("_seen"))
    window = Window.partitionBy(*item)
    best = votes.withColumn("_rn", F.row_number().over(window.orderBy(F.desc("votes"), "_seen", value))).withColumn("raters", F.sum("votes").over(window))
    return best.where("_rn = 1").drop("_rn", "_seen").withColumn("majority", 2 * F.col("votes") > F.col("raters"))


def majority_members(df: DataFrame, item: Sequence[str], rater: str, member: str) -> DataFrame:
    """Set members named by more than half of an item's raters."""
    raters = df.groupBy(*item).agg(F.countDistinct(rater).alias("raters"))
    named = df.where(F.col(member).isNotNull()).groupBy(*item, member).agg(F.countDistinct(rater).alias("votes"))
    return named.join(raters, list(item)).where("2 * votes > raters")


def agreement_counts(df: DataFrame, item: Sequence[str], category: str) -> DataFrame:
    """counts[item, category] in long form."""
    return df.where(F.col(category).isNotNull()).groupBy(*item, category).agg(F.count("*").alias("n"))


def agreement(counts: DataFrame, item: Sequence[str], category: str, by: Sequence[str] = ()) -> DataFrame:
    """Items, observed agreement, Fleiss kappa (variable raters) and Gwet AC1, over items with two ratings or more."""
    keys = [*by, *item]
    per_item = counts.groupBy(*keys).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("q")).where("r > 1")
    observed = per_item.groupBy(*by).agg(F.count("*").alias("items"), F.avg((F.col("q") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("observed"), F.sum("r").alias("ratings"))
    rated = counts.join(per_item.select(*keys, "r"), keys)
    shares = rated.groupBy(*by, category).agg(F.sum("n").alias("_n"), F.sum(F.col("n") / F.col("r")).alias("_pi"))
    joined = shares.join(observed, list(by)) if by else shares.crossJoin(F.broadcast(observed))
    p, pi = F.col("_n") / F.col("ratings"), F.col("_pi") / F.col("items")
    chance = joined.groupBy(*by, "items", "observed").agg(F.sum(p * p).alias("_fleiss"), F.sum(pi * (1 - pi)).alias("_gwet"), F.count("*").alias("categories"))
    gwet = F.when(F.col("categories") > 1, F.col("_gwet") / (F.col("categories") - 1)).otherwise(0.0)
    kappa = lambda e: F.when(e < 1, (F.col("observed") - e) / (1 - e))
    return chance.select(*by, "items", "categories", "observed", kappa(F.col("_fleiss")).alias("fleiss_kappa"), kappa(gwet).alias("gwet_ac1"))


def bootstrap_interval(values: Sequence[float], statistic, rounds: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval from resampled items; for the few items of an agreement study, on the driver."""
    rng, n = random.Random(seed), len(values)
    drawn = sorted(statistic([values[rng.randrange(n)] for _ in range(n)]) for _ in range(rounds))
    at = lambda p: drawn[min(rounds - 1, max(0, round(p * (rounds - 1))))]
    return at((1 - level) / 2), at((1 + level) / 2)
