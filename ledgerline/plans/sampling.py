"""Sampling that repeats in any engine: md5 orders, quotas from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import sampling
from ledgerline.plans.base import Tables, query


@query("prefix_balanced_order", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || 's'), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, CAST(row_number() OVER (ORDER BY k, n DESC, lang) AS INT) AS place FROM r")
def _(t: Tables) -> DataFrame:
    return sampling.interleaved(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", "s").select("doc_id", "place")


@query(
    "stratified_sample",
    """WITH s AS (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT s, n, least(n, greatest(2, round_even(500.0 * n / (SELECT sum(n) FROM s), 0))) AS want, 500.0 * n / (SELECT sum(n) FROM s) AS exact FROM s),
g AS (SELECT *, CAST(500 - (SELECT sum(want) FROM q) AS INT) AS gap, row_number() OVER (ORDER BY exact - want DESC, s) AS up, row_number() OVER (ORDER BY want - exact DESC, s) AS down FROM q),
f AS (SELECT s, want + CASE WHEN gap > 0 AND up <= gap THEN 1 WHEN gap < 0 AND down <= -gap THEN -1 ELSE 0 END AS want FROM g),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderpriority FROM r JOIN f ON s = o_orderpriority WHERE k <= want""",
)
def _(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.orders.select("o_orderkey", "o_orderpriority"), 500, ["o_orderpriority"], "o_orderkey")


@query("shard_of_rows", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def _(t: Tables) -> DataFrame:
    return sampling.shard(t.documents, "doc_id", 8, 3).select("doc_id")


@query("excluded_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || 'x'), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 50")
def _(t: Tables) -> DataFrame:
    pool = t.documents.select("doc_id").join(t.labels.select("doc_id").distinct(), "doc_id", "left_anti")
    return pool.orderBy(sampling.shuffled("doc_id", "x"), "doc_id").limit(50)


@query("quota_draw")
def _(t: Tables) -> DataFrame:
    """40 documents under quotas of language and source, from all documents in hash order."""
    pool = [r.asDict() for r in sampling.quota_pool(t.documents.select("doc_id", "lang", "source"), 40, ["lang", "source"], "doc_id", "q").collect()]
    langs = sampling.largest_remainder({"en": 3, "fr": 1, "de": 1, "es": 1}, 40)
    sources = {r["source"]: 4 for r in pool}
    drawn = sampling.quota_draw(pool, 40, {"lang": langs, "source": sources}, "doc_id")
    return t.spark.createDataFrame([(r["doc_id"], r["lang"], r["source"]) for r in drawn], "doc_id long, lang string, source string")
