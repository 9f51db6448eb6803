"""Bias classes, breakdowns, ranks, curves, cross-tabulations and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import recode
from ledgerline.operators import joins, summaries
from ledgerline.plans.base import Tables, query

CLASSES = ((0.1, "ignored"), (0.35, "under"), (0.65, "average"), (0.9, "over"))
_CLASS = "CASE WHEN p < 0.1 THEN 'ignored' WHEN p < 0.35 THEN 'under' WHEN p < 0.65 THEN 'average' WHEN p < 0.9 THEN 'over' ELSE 'hotspot' END"
_NATION = "c AS (SELECT n_nationkey, n_name, n_regionkey, count(o_orderkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY ALL)"


def _per_nation(t: Tables) -> DataFrame:
    rows = t.orders.where("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return joins.lookup(t.nation.select("n_nationkey", "n_name", "n_regionkey"), counts, ["n_nationkey"], {"n": 0})


@query("bias_class_percentile", f"WITH {_NATION}, r AS (SELECT n_name, n, percent_rank() OVER (ORDER BY n) AS p FROM c) SELECT n_name, n, round(p, 6) AS percentile, {_CLASS} AS bias_class FROM r")
def _(t: Tables) -> DataFrame:
    return summaries.percentile_class(_per_nation(t), "n", CLASSES, "hotspot").select("n_name", "n", F.round("percentile", 6).alias("percentile"), "bias_class")


@query(
    "group_breakdown",
    f"""WITH {_NATION} SELECT n_regionkey, count(DISTINCT n_nationkey) AS entities, CAST(count(*) FILTER (n < 300) AS BIGINT) AS under, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, median(n) AS median, max(n) AS largest,
  round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS coverage_percent, round(100.0 * max(n) / sum(n), 6) AS concentration_percent FROM c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    out = summaries.breakdown(_per_nation(t), "n_regionkey", "n", "n_nationkey", 300)
    return out.select("n_regionkey", "entities", "under", "total", F.round("mean", 6).alias("mean"), "median", "largest", F.round("coverage_percent", 6).alias("coverage_percent"), F.round("concentration_percent", 6).alias("concentration_percent"))


@query("bias_heatmap", f"WITH {_NATION}, r AS (SELECT n_regionkey, percent_rank() OVER (ORDER BY n) AS p FROM c), k AS (SELECT n_regionkey, {_CLASS} AS bias_class FROM r) SELECT n_regionkey, bias_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey), 6) AS share FROM k GROUP BY n_regionkey, bias_class")
def _(t: Tables) -> DataFrame:
    classes = summaries.percentile_class(_per_nation(t), "n", CLASSES, "hotspot").drop("n")
    return summaries.counted(classes, ["n_regionkey", "bias_class"], within=["n_regionkey"]).withColumn("share", F.round("share", 6))


@query("quartile_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS tile FROM customer")
def _(t: Tables) -> DataFrame:
    return summaries.quartiles(t.customer, "c_acctbal", "c_custkey", ["c_mktsegment"]).select("c_custkey", "tile")


@query(
    "quartile_qcut",
    """WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, CAST(1 + (r > 1 + (n - 1) / 4)::INT + (r > 1 + 2 * (n - 1) / 4)::INT + (r > 1 + 3 * (n - 1) / 4)::INT AS INT) AS tile FROM r""",
)
def _(t: Tables) -> DataFrame:
    return summaries.cut_quantiles(t.customer, "c_acctbal", "c_custkey", ["c_mktsegment"]).select("c_custkey", "tile")


@query("quartile_medians", "WITH q AS (SELECT c_mktsegment, c_acctbal, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS tile FROM customer) SELECT c_mktsegment, CAST(tile AS INT) AS tile, round(median(c_acctbal), 4) AS median FROM q GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return summaries.quartiles(t.customer, "c_acctbal", "c_custkey", ["c_mktsegment"]).groupBy("c_mktsegment", "tile").agg(F.round(F.median("c_acctbal"), 4).alias("median"))


@query(
    "coverage_curve",
    """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS place, sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) AS running FROM c)
SELECT p_brand, n, CAST(place AS INT) AS place, CAST(running AS BIGINT) AS running, round(running / (SELECT sum(n) FROM c), 6) AS running_share FROM r""",
)
def _(t: Tables) -> DataFrame:
    return summaries.coverage_curve(summaries.counted(t.part, ["p_brand"], share=None), "p_brand").withColumn("running_share", F.round("running_share", 6))


@query("min_max_rescale", "WITH w AS (SELECT *, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier) SELECT s_suppkey, round(CASE WHEN hi = lo THEN 0.5 ELSE (s_acctbal - lo) / (hi - lo) END, 6) AS scaled FROM w")
def _(t: Tables) -> DataFrame:
    return summaries.rescaled(t.supplier, "s_acctbal", ["s_nationkey"]).select("s_suppkey", F.round("scaled", 6).alias("scaled"))


@query("top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def _(t: Tables) -> DataFrame:
    return summaries.top(summaries.counted(t.lineitem, ["l_partkey"], share=None), 10, "n", "l_partkey")


@query("top_k_ties", "SELECT l_partkey, n FROM (SELECT l_partkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1) WHERE r <= 5")
def _(t: Tables) -> DataFrame:
    return summaries.top(summaries.counted(t.lineitem, ["l_partkey"], share=None), 5, "n", "l_partkey", ties=True)


@query("top_k_per_group", "SELECT c_nationkey, c_custkey, n FROM (SELECT c_nationkey, c_custkey, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_custkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey) WHERE r <= 3")
def _(t: Tables) -> DataFrame:
    counts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count("*").alias("n"))
    return summaries.top(counts, 3, "n", "c_custkey", ["c_nationkey"])


@query("year_trend_topk", "WITH y AS (SELECT year(o_orderdate) AS year, n_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), k AS (SELECT n_name FROM y GROUP BY 1 ORDER BY sum(n) DESC, n_name LIMIT 8) SELECT year, n_name, n FROM y WHERE n_name IN (SELECT n_name FROM k)")
def _(t: Tables) -> DataFrame:
    rows = joins.lookup(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "n_nationkey"), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    yearly = rows.groupBy(F.year("o_orderdate").alias("year"), "n_name").agg(F.count("*").alias("n"))
    most = summaries.top(yearly.groupBy("n_name").agg(F.sum("n").alias("n")), 8, "n", "n_name")
    return joins.among(yearly, most, ["n_name"]).select("year", "n_name", "n")


STATUSES = ("F", "O", "P")


@query("crosstab_pivot_total", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.matrix(t.orders, "o_orderpriority", "o_orderstatus", STATUSES)


@query("crosstab_entities", "SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS F, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS O, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P') AS P, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') + count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') + count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P') AS total FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.matrix(t.orders, "o_orderpriority", "o_orderstatus", STATUSES, "o_custkey")


@query("long_form", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    wide = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return summaries.long(wide, ["s_suppkey"], ["balance", "nation"])


@query("first_by_pivot", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS F, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS O, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.first_by_pivot(t.orders, "o_custkey", "o_orderstatus", STATUSES, "o_totalprice", "o_orderkey")


@query("joined_values", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.joined_values(t.orders, ["o_custkey"], "o_orderpriority")


@query("latest_value", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.latest(t.orders, ["o_custkey"], "o_totalprice", ["o_orderdate", "o_orderkey"])


@query("modal_value", "SELECT o_custkey, o_orderpriority, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1")
def _(t: Tables) -> DataFrame:
    return summaries.modal(t.orders, ["o_custkey"], "o_orderpriority")


@query(
    "missingness_report",
    """SELECT 'lang' AS "column", count(*) AS rows, count(*) FILTER (lang IS NULL OR lower(trim(lang)) IN ('', 'es')) AS missing, round(100.0 * count(*) FILTER (lang IS NULL OR lower(trim(lang)) IN ('', 'es')) / count(*), 6) AS missing_percent FROM documents
UNION ALL SELECT 'n_chars', count(*), count(*) FILTER (n_chars IS NULL), round(100.0 * count(*) FILTER (n_chars IS NULL) / count(*), 6) FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return summaries.missingness(t.documents, ["lang", "n_chars"], ["", "es"]).withColumn("missing_percent", F.round("missing_percent", 6))


@query("status_histogram", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(t: Tables) -> DataFrame:
    return summaries.histogram(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("run_statistics", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, max(value) FILTER (r = floor(0.5 * (n - 1)) + 1) AS p50, max(value) FILTER (r = floor(0.95 * (n - 1)) + 1) AS p95 FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.run_statistics(t.events, ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("cube_totals", "SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS grouping_id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def _(t: Tables) -> DataFrame:
    return summaries.grouped_sets(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice").withColumn("total", F.round("total", 2))


@query("distinct_entities", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) AS orders, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"), F.count("*").alias("orders"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"))


@query("merged_groups", "SELECT CASE WHEN n_nationkey < 10 THEN 'UNION' ELSE n_name END AS area, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = joins.lookup(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    area = recode("n_name", {f"NATION_{i}": "UNION" for i in range(10)})
    return rows.groupBy(area.alias("area")).agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query("rate_by_group", "SELECT l_shipdate IS NULL AS undated, round(avg((l_returnflag = 'R')::INT), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_shipdate").isNull().alias("undated")).agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("rate"), F.count("*").alias("n"))
