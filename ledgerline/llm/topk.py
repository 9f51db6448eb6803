"""Exact top-k by inner product with no-random-access aggregation.

Each dimension of a block of candidates is a list sorted by value; a query reads it from the end that
helps it, value by value.  What was read of a candidate gives a lower bound of its score (values not read
yet are the list's far end) and an upper bound (they are no better than where reading stands).  At each
look, candidates whose upper bound is below the k-th best lower bound, or below the k-th score of the
blocks before, are out; a query stops when no outsider can qualify, that is when at most k are left, and a
block whose list ends already say that nothing in it can qualify is not read.  Then reading goes on,
only in the lists and only as far as needed, until every value of those left was read: their bounds have
met, which is the score.  Nothing is ever looked up by row.  Bounds of many queries at once are matrix
products, so nothing loops over pairs.

How much is read before a query stops depends on the data: of lists whose values differ little from one
another nearly everything, of skewed ones little (README has figures).

Candidates are packed into blocks where they are.  Queries are dealt into groups of at most ``HELD`` that
a task can hold, and groups and cells of candidate blocks form a grid: a candidate block travels once for
each group of queries, not for each block of them.  The best k of each query from all tasks meet in a
ranked window that Spark cuts to k rows before it shuffles.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; rows
without an id neither; only vectors of one length are compared; rows with a query's own id are not its
candidates; rows that repeat an id are each a candidate, and each a query with ranks of its own; ties go to
the smaller id; a query with fewer candidates gets them all; an empty table gives an empty result; columns
besides id and vector are ignored, whatever their names.  Scores are exact while sums of products stay below
2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, shuffle_partitions, table
from ledgerline.llm.vectors import blocks, dealt, matrix, usable

SCALE, K, EVERY = 256.0, 5, 50
#: Shares of the lists that are read before each look at the bounds.
LOOKS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)
#: Rows of a block, queries that a task holds, and queries whose bounds are made at once.
BLOCK, HELD, AT_ONCE = 2048, 1 << 15, 256


class Lists:
    """The sorted lists of a block of candidates, one for each dimension."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, n = rows, len(rows)
        order = np.argsort(rows, axis=0, kind="stable")
        self.from_bottom = np.empty(rows.shape, np.int32)
        np.put_along_axis(self.from_bottom, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.from_top = n - 1 - self.from_bottom
        self.sorted = np.take_along_axis(rows, order, axis=0)

    def most(self, queries: np.ndarray) -> np.ndarray:
        """The best score that the ends of the lists allow."""
        return np.maximum(queries, 0) @ self.sorted[-1] + np.minimum(queries, 0) @ self.sorted[0]

    def bounds(self, queries: np.ndarray, depth: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of queries x ``some`` candidates after ``depth`` values of each list."""
        plus, minus, n = np.maximum(queries, 0), np.minimum(queries, 0), len(self.rows)
        value, top, bottom = self.rows[some], self.from_top[some] < depth, self.from_bottom[some] < depth
        lower = plus @ np.where(top, value, self.sorted[0]).T + minus @ np.where(bottom, value, self.sorted[-1]).T
        upper = plus @ np.where(top, value, self.sorted[n - depth]).T + minus @ np.where(bottom, value, self.sorted[depth - 1]).T
        return lower, upper

    def resolved(self, query: np.ndarray, depth: int, some: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores of ``some`` candidates after reading on until all their values were met, and the values read in all."""
        met = np.where(query > 0, self.from_top[some], self.from_bottom[some]).max(axis=0) + 1
        return self.rows[some] @ query, int(np.maximum(met, depth)[query != 0].sum())


def nearest(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Per query: its number, ids and scores of the candidates that may be among its k best, and how many values were read.

    ``floor``: scores that a candidate must reach, from what was seen before.
    """
    n = len(ids)
    left = query_ids[:, None] != ids[None, :]
    left[lists.most(queries) < floor] = False
    stop = np.where(left.any(axis=1), n, 0)
    reading = np.flatnonzero(stop)
    for share in LOOKS:
        if not len(reading):
            break
        depth = max(1, math.ceil(share * n))
        some = np.flatnonzero(left[reading].any(axis=0))
        lower, upper = lists.bounds(queries[reading], depth, some)
        now = left[np.ix_(reading, some)]
        bound = floor[reading]
        if len(some) > k:
            lower[~now] = -np.inf
            bound = np.maximum(bound, np.partition(lower, len(some) - k, axis=1)[:, len(some) - k])
        now &= upper >= bound[:, None]
        left[np.ix_(reading, some)] = now
        stop[reading] = depth
        reading = reading[now.sum(axis=1) > k]
    for i in range(len(queries)):
        among = np.flatnonzero(left[i])
        if len(among):
            scores, read = lists.resolved(queries[i], int(stop[i]), among)
            yield i, ids[among], scores, read
        else:
            yield i, ids[:0], np.empty(0), int(stop[i]) * int(np.count_nonzero(queries[i]))


class Asked:
    """A block of queries and the best that was found for each so far."""

    def __init__(self, block: int, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.block, self.ids, self.rows, self.k = block, ids, rows, k
        self.best = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, lists: Lists) -> None:
        for at in range(0, len(self.ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            for i, near, scores, _ in nearest(self.rows[part], self.ids[part], lists, ids, self.k, self.floor[part]):
                if len(near):
                    near, scores = (np.concatenate(x) for x in zip(self.best[at + i], (near, scores)))
                    order = np.lexsort((near, -scores))[: self.k]
                    self.best[at + i] = near[order], scores[order]
                    if len(order) == self.k:
                        self.floor[at + i] = scores[order[-1]]

    def found(self) -> pa.RecordBatch:
        size = [len(x) for x, _ in self.best]
        made = [np.full(sum(size), self.block), np.repeat(np.arange(len(size)), size), np.repeat(self.ids, size), *(np.concatenate([b[j] for b in self.best]).astype(np.int64) for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["block", "nth", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each row where ``is_query``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    partitions = shuffle_partitions(spark)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    part = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    row = (F.col(id_col).cast("long").alias("id"), whole.alias("vector"))
    # Written, so that the number of a query within its block is one and the same for all tasks.
    asked = cut(blocks(part.where(is_query).select(*row), block), "topk-queries")
    groups = max(1, math.ceil((asked.agg(F.sum("n")).first()[0] or 0) / held))
    cells = max(1, math.ceil(partitions / groups))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = F.col("block")
    queries = asked.select("*", F.lit(0).alias("kind"), dealt(number, groups).alias("group"), to(cells).alias("cell"))
    candidates = blocks(part.select(*row), block).select("*", F.lit(1).alias("kind"), to(groups).alias("group"), dealt(number, cells).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("dim", "group", "cell", "kind", "block")))
            for nth, (dim, group, cell, kind, number) in enumerate(keys):
                if (dim, group, cell) != at:
                    yield from (a.found() for a in asking)
                    at, asking = (dim, group, cell), []
                ids, rows = np.frombuffer(batch.column("ids")[nth].as_py(), np.int64), matrix(batch.column("rows")[nth].as_py(), dim)
                if kind == 0:
                    asking.append(Asked(number, ids, rows, k))
                elif asking:
                    lists = Lists(rows)
                    for a in asking:
                        a.meet(ids, lists)
        yield from (a.found() for a in asking)

    # One task for each place of the grid; a hash would give some tasks two and others none.
    grid = queries.unionByName(candidates).repartitionById(groups * cells, F.col("group") * cells + F.col("cell")).sortWithinPartitions("dim", "group", "cell", "kind", "block")
    best = grid.mapInArrow(run, "block long, nth long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("block", "nth").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {K}"""
