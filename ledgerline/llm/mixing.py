"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of expected copies, target / source size, at
most 2.  The whole part is taken; the fractional part becomes 0 or 1 by pivotal steps: two documents
with open fractions move words from one to the other, up or down at random so that both expectations
stay, until one of the fractions is 0 or 1.  A step keeps the sum of words, so a source's words reach
its target but for the last open document.

The steps form a reduction tree: leaves are fixed ranges of a hash of the row within a source, each
leaf leaves at most one open document, and sixteen leaves meet in one node of the next level.  Leaves
and random numbers depend on the rows alone, never on partitions, so reruns agree and a lost
executor's work comes out the same.  A hot source is spread over many leaves.  Rows that are equal in all
columns are one item of the tree, with their expected copies summed up, so however many there are they make
one row of one leaf.

Defined results: a null text has size 0; a document of size 0 is taken with its fraction as chance
(0 words); the null source is a source of its own, last in order; sources that reach their cap together do
so in the order of their names; equal rows are interchangeable, and their copies differ by one at most;
rows without an id are told apart by their other columns; an empty table gives an empty result; columns
besides id, text and source pass through ``mix``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, shuffle_partitions, table

WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words, and the most copies of a document.
BUDGET, CAP = 1.5, 2.0
#: Rows of a leaf, roughly, and bits of the hash that a level of the tree merges.
LEAF, STEP = 512, 4
#: Equal rows that are written out at once.
MANY = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row per source: source_size and target.

    Targets are level * weight, cut at cap * source_size; the level is the one where they use up the
    budget, found by walking the sources in the order in which they reach their cap.  There is one row
    per source, so the walk is a window over a small table.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    rows = totals.withColumn("weight", weight).withColumn("stop", cap * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("place", F.row_number().over(by_stop)).withColumn("level", (budget * everything - before) / weights_left)
    reached = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("place", "level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = F.coalesce(reached["level"], F.lit(float("inf")))
    return rows.select("source", "source_size", F.least(cap * F.col("source_size"), level * F.col("weight")).alias("target"))


def _unit(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two row hashes."""
    import xxhash

    return xxhash.xxh3_64_intdigest(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), seed) / 2.0**64


def pivot(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """One step for fractions p, q of documents with s, t words: the sum of words stays, one fraction closes."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0, q - up / t) if (1 - p) * s < q * t else ((1.0 if (1 - p) * s == q * t else p + up / s), 0.0)
    return (0.0, q + down / t) if p * s < (1 - q) * t else ((0.0 if p * s == (1 - q) * t else p - down / s), 1.0)


ROW = "row_hash long, row_id long, key long, alike long, source string, size long, source_size long, target double, whole long, part double, leaf long"


def _level(rows: DataFrame, seed: int, root: bool) -> DataFrame:
    """Pivotal steps within each (source, leaf): afterwards at most one row of each has an open part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_row, schema = None, None, None
        for batch in batches:
            schema, out = batch.schema, []
            for r in batch.to_pylist():
                if (here := (r["source"], r["leaf"])) != at:
                    if open_row:
                        out.append(open_row)
                    at, open_row = here, None
                if not 0 < r["part"] < 1:
                    out.append(r)
                elif r["size"] == 0:
                    r["part"] = float(_unit(r["row_hash"], 0, seed) < r["part"])
                    out.append(r)
                elif open_row is None:
                    open_row = r
                else:
                    a, b = open_row, r
                    a["part"], b["part"] = pivot(a["part"], a["size"], b["part"], b["size"], _unit(a["row_hash"], b["row_hash"], seed))
                    still = [x for x in (a, b) if 0 < x["part"] < 1]
                    out += [x for x in (a, b) if not 0 < x["part"] < 1]
                    open_row = still[0] if still else None
            yield pa.RecordBatch.from_pylist([_closed(x, seed) if root and 0 < x["part"] < 1 else x for x in out], schema=schema)
        if open_row:
            yield pa.RecordBatch.from_pylist([_closed(open_row, seed) if root else open_row], schema=schema)

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "source", "leaf")
    return dealt.sortWithinPartitions("source", "leaf", "row_hash", "key", "row_id", "size").mapInArrow(run, ROW)


def _closed(row: dict, seed: int) -> dict:
    return row | {"part": float(_unit(row["row_hash"], 1, seed) < row["part"])}


def _key(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, by their text."""
    return F.xxhash64(*(F.to_json(f"`{c}`") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row per document: row_id, key (hash of all its columns), source, size, source_size, target, copies."""
    each = _alike(docs, id_col, text_col, source_col, seed)
    # The first of equal rows take one more where their copies don't come out even; two steps keep arrays short.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / MANY)))
    rows = each.withColumn("_at", some)
    nth = F.explode(F.sequence(F.col("_at") * MANY, F.least((F.col("_at") + 1) * MANY, F.col("alike")) - 1))
    copies = F.floor(F.col("copies") / F.col("alike")) + (F.col("_nth") < F.col("copies") % F.col("alike")).cast("int")
    return rows.withColumn("_nth", nth).withColumn("copies", copies.cast("int")).drop("_at", "_nth", "alike")


def _alike(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """One row per set of equal documents: as ``mixed``, with their number in ``alike`` and all their copies together."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("row_id"), _key(docs).alias("key"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    sized = cut(own.groupBy("row_id", "key", "source", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    bits = max(0, math.ceil(math.log2(max(sized.count(), 1) / LEAF)))
    aim = targets(sized).withColumnRenamed("source", "of")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CAP))).otherwise(0.0)
    rows = sized.join(aim, sized["source"].eqNullSafe(aim["of"])).withColumn("expected", share * F.col("alike"))
    row_hash = F.xxhash64("row_id", "key", F.lit(seed))
    level = rows.select(
        row_hash.alias("row_hash"), "row_id", "key", "alike", "source", "size", "source_size", "target",
        F.floor("expected").cast("long").alias("whole"), (F.col("expected") - F.floor("expected")).alias("part"),
        F.shiftrightunsigned(row_hash, 64 - bits).alias("leaf") if bits else F.lit(0).cast("long").alias("leaf"),
    )
    done = []
    while True:
        level = cut(_level(level, seed, root=bits == 0), "mix-level")
        is_open = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(level.where(~is_open))
        if bits == 0:
            break
        merge = min(STEP, bits)
        bits -= merge
        level = level.where(is_open).withColumn("leaf", F.shiftright("leaf", merge))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select("row_id", "key", "alike", "source", "size", "source_size", "target", (F.col("whole") + F.col("part").cast("int")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was taken (0, 1 or 2 times), with its own columns.

    Of equal rows one stands for all and is repeated as often as all of them were taken.
    """
    taken = _alike(docs, id_col, text_col, source_col, seed).where("copies > 0").select("row_id", "key", "alike", "copies")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own_id"), _key(docs).alias("own_key"))
    joined = rows.join(taken, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("row_id")))
    # The rank is cut to one before the shuffle, so equal rows make no hot task; their copies are written by many.
    nth = F.row_number().over(Window.partitionBy("key", "row_id").orderBy("key"))
    one = joined.where("alike > 1").withColumn("nth", nth).where("nth = 1").drop("nth")
    parts = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / MANY)))).repartition(shuffle_partitions(docs.sparkSession), "key", "part")
    many = parts.withColumn("n", F.explode(F.sequence(F.col("part") * MANY + 1, F.least((F.col("part") + 1) * MANY, F.col("copies")))))
    every = joined.where("alike = 1").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row").unionByName(many.select("row"))
    return every.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
