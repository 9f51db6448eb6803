"""Lookups, existence joins, upserts and completed grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is only hinted for broadcast if the optimizer's own size estimate stays below this many bytes.
SMALL = 32 << 20


def estimated_size(df: DataFrame) -> int:
    """Bytes, by the optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is under the limit; else unchanged (shuffled, skew handled by AQE)."""
    return F.broadcast(df) if estimated_size(df) <= limit else df


def unique_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: the first by ``order`` (by default, by all other columns)."""
    rest = order or [c for c in df.columns if c not in key] or list(key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*rest))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def lookup(facts: DataFrame, dimension: DataFrame, on: Sequence[str], default: dict[str, object] | None = None) -> DataFrame:
    """Left join that never multiplies rows: the dimension is reduced to one row per key first."""
    out = facts.join(small(unique_by(dimension, on)), list(on), "left")
    return out.fillna(default) if default else out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts: empty if a many-to-one join is safe."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def prioritised_lookup(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` by the first key that finds one; later keys only fill what is still null."""
    out = facts
    found: list[Column] = []
    for i, key in enumerate(keys):
        side = unique_by(dimension.where(F.col(key).isNotNull()).select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), [f"_k{i}"])
        earlier = F.coalesce(*found, F.lit(None)) if found else F.lit(None)
        out = out.join(small(side), (F.col(key) == F.col(f"_k{i}")) & (earlier.isNull() if found else F.lit(True)), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_k{i}" for i in range(len(keys))), *(f"_v{i}" for i in range(len(keys))))


def role_lookups(facts: DataFrame, dimension: DataFrame, key: str, roles: dict[str, str], take: Sequence[str]) -> DataFrame:
    """One dimension joined in several roles: {foreign key: prefix}."""
    out = facts
    base = unique_by(dimension, [key])
    for foreign, prefix in roles.items():
        side = base.select(F.col(key).alias(f"_{prefix}"), *(F.col(c).alias(f"{prefix}_{c}") for c in take))
        out = out.join(small(side), F.col(foreign) == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    return out


def known_minus(known: DataFrame, studied: DataFrame, key: Column) -> DataFrame:
    """Rows of ``known`` whose key is not among the keys of ``studied`` (anti join on a derived key)."""
    return known.withColumn("_key", key).join(studied.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def among(facts: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    return facts.join(wanted.select(*on).distinct(), list(on), "left_semi")


def upsert(main: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """``main`` with each cell replaced where ``fresh`` has a non-null value for the same key; new keys are not added."""
    update = unique_by(fresh, key).select(*key, *(F.col(c).alias(f"_new_{c}") for c in fresh.columns if c not in key))
    joined = main.join(small(update), list(key), "left")
    return joined.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fresh.columns and c not in key else F.col(c) for c in main.columns))


def compared(left: DataFrame, right: DataFrame, key: Sequence[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two result tables; what one lacks counts 0."""
    a, b = left.select(*key, F.col(value).alias(names[0])), right.select(*key, F.col(value).alias(names[1]))
    return a.join(b, list(key), "full").fillna(0, list(names))


def overlap(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys only in the left, in both, only in the right."""
    a, b = left.select(*key).distinct().withColumn("_l", F.lit(1)), right.select(*key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(key), "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def complete(df: DataFrame, dims: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Every combination of the dimensions' distinct values, with ``fill`` where there was no row.

    The grid is the point of the operator, and its size the product of the dimensions'.  Values are few by
    nature; a dimension is broadcast only where its estimated size is small.
    """
    grid = None
    for d in dims:
        values = df.select(d).where(F.col(d).isNotNull()).distinct()
        grid = values if grid is None else grid.join(small(values), how="cross")
    return grid.join(df, list(dims), "left").fillna(fill)


def pairs_within(df: DataFrame, group: str, item: str, most: int = 200) -> DataFrame:
    """(a, b, n): how many groups hold both items, a < b.

    Distinct items of a group are dealt into tiles of about ``most``, one for a small group, and each pair of
    tiles of a group is a row of its own; so a large group is neither refused nor gathered in one place, and
    an array holds two tiles at most.
    """
    items = df.where(F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    tiles = items.groupBy("g").agg(F.ceil(F.count("*") / most).alias("tiles"))
    dealt = items.join(tiles, "g").withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.select("g", "x", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    side = lambda which: F.collect_list(F.when(F.col("tile") == F.col(which), F.col("x"))).alias(f"in_{which}")
    met = cells.groupBy("g", "low", "high").agg(side("low"), side("high"))
    first = met.select("low", "high", "in_high", F.explode("in_low").alias("a"))
    within = F.col("low") == F.col("high")
    both = first.select("a", F.explode(F.filter("in_high", lambda x: ~within | (x > F.col("a")))).alias("b"))
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def first_existing(df: DataFrame, key: str, candidates: Sequence[Column], listing: DataFrame, name: str) -> DataFrame:
    """The first of several candidate names per row that is in the listing; one shuffle for all candidates."""
    tried = df.select(key, F.posexplode(F.array(*candidates)).alias("_place", "_name")).where("_name is not null")
    there = tried.join(listing.select(F.col(name).alias("_name")).distinct(), "_name", "left_semi")
    best = there.groupBy(key).agg(F.min_by("_name", "_place").alias(name))
    return df.join(best, key, "left")


def joined_on(left: DataFrame, right: DataFrame, key: Column, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on a derived key; columns that both sides have get suffixes."""
    both = set(left.columns) & set(right.columns)
    sides = [df.select(key.alias("join_key"), *(F.col(c).alias(c + s if c in both else c) for c in df.columns)) for df, s in zip((left, right), suffixes)]
    return sides[0].join(sides[1], "join_key", how)
