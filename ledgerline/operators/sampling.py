"""Sampling that repeats: rows are ordered by a hash of their id, quotas are computed from counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import small
from ledgerline.operators.ranks import ordered


def shuffled(key: str, seed: str = "") -> Column:
    """An order like a random one, the same in every run and engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def allocate(counts: Mapping[str, int], total: int, floor: int = 2) -> dict[str, int]:
    """Proportional quotas of at least ``floor`` (or all there are), repaired one by one to sum to ``total``."""
    whole = sum(counts.values())
    want = {k: min(n, max(floor, round(total * n / whole))) for k, n in counts.items()} if whole else {}
    target = min(total, whole)
    while (gap := target - sum(want.values())) != 0:
        step = 1 if gap > 0 else -1
        free = [k for k in want if (want[k] < counts[k] if step > 0 else want[k] > min(floor, counts[k]))]
        if not free:
            break
        k = max(sorted(free), key=lambda k: step * (total * counts[k] / whole - want[k]))
        want[k] += step
    return want


def largest_remainder(weights: Mapping[str, float], n: int, floor: int = 0, cap: Mapping[str, int] | None = None) -> dict[str, int]:
    """Whole-number shares of ``n`` by weight; what rounding leaves goes to the largest remainders, ties by name."""
    whole = sum(weights.values())
    exact = {k: n * w / whole for k, w in weights.items()}
    most = {k: (cap or {}).get(k, n) for k in weights}
    out = {k: min(most[k], max(floor, math.floor(x))) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - math.floor(exact[k])), k)) * (n + 1):
        if sum(out.values()) >= n:
            break
        if out[k] < most[k]:
            out[k] += 1
    return out


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: str = "", floor: int = 2) -> DataFrame:
    """About ``n`` rows in proportion to the strata, at least ``floor`` of each.

    Only the strata's counts come to the driver; the rank limit cuts each stratum before the shuffle.
    """
    name = F.concat_ws("\u0001", *(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata))
    counts = {r[0]: r[1] for r in df.groupBy(name.alias("s")).agg(F.count("*")).collect()}
    quotas = df.sparkSession.createDataFrame([*allocate(counts, n, floor).items()] or [("", 0)], "_stratum string, _quota int")
    largest = max(allocate(counts, n, floor).values(), default=0)
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(shuffled(key, seed), key))
    ranked = df.withColumn("_stratum", name).withColumn("_rank", rank).where(F.col("_rank") <= largest)
    return ranked.join(small(quotas), "_stratum").where("_rank <= _quota").drop("_stratum", "_rank", "_quota")


def quota_draw(pool: Sequence[dict], n: int, quotas: Mapping[str, Mapping[str, int]], key: str) -> list[dict]:
    """Greedy draw under marginal quotas ({column: {value: most}}) in the order of ``pool``, then filled up regardless.

    The order is sequential by nature, so this runs on the driver; ``quota_pool`` makes the pool small.
    """
    left = {c: dict(q) for c, q in quotas.items()}
    taken, rest = [], []
    for row in pool:
        fits = len(taken) < n and all(left[c].get(row[c], 0) > 0 for c in left)
        (taken if fits else rest).append(row)
        if fits:
            for c in left:
                left[c][row[c]] -= 1
    return taken + rest[: n - len(taken)]


def quota_pool(df: DataFrame, n: int, columns: Sequence[str], key: str, seed: str = "") -> DataFrame:
    """The rows in hash order that decide a ``quota_draw`` of ``n`` from all of ``df``: the first ``n`` of each cell of the columns.

    Rows of a cell fit alike and quotas only shrink, so a draw takes a beginning of every cell, and no more than ``n`` rows.
    """
    order = [shuffled(key, seed), F.col(key)]
    rank = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank").orderBy(*order)


def interleaved(df: DataFrame, strata: Sequence[str], key: str, seed: str = "", name: str = "place") -> DataFrame:
    """Rows in rounds, one of each stratum a round, so every beginning of the list is balanced; larger strata first."""
    window = Window.partitionBy(*strata)
    ranked = df.withColumn("_round", F.row_number().over(window.orderBy(shuffled(key, seed), key))).withColumn("_size", F.count("*").over(window))
    return ordered(ranked, "_round", [F.desc("_size"), *strata]).withColumn(name, F.col("_place").cast("int")).drop("_round", "_size", "_place", "_total", "_before")


def shard(df: DataFrame, number: str, shards: int, mine: int) -> DataFrame:
    """The rows of one shard by row number modulo."""
    return df.where(F.pmod(F.col(number), F.lit(shards)) == mine)
