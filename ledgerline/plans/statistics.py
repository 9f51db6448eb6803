"""Tests, correlations, agreement and scores.  Statistics are compared by SQL, probabilities by unit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import agreement, stats
from ledgerline.plans.base import Tables, query


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


_SUPPLIER = "r AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1)"


def _supplier(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))


@query("pearson", f"WITH {_SUPPLIER} SELECT count(*) AS n, round(corr(n, p), 6) AS r FROM r")
def _(t: Tables) -> DataFrame:
    return _rounded(stats.pearson(_supplier(t), "n", "p"), "r")


def _ranks(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("spearman", f"WITH {_SUPPLIER}, k AS (SELECT {_ranks('n')} AS a, {_ranks('p')} AS b FROM r) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k")
def _(t: Tables) -> DataFrame:
    return _rounded(stats.spearman(_supplier(t), "n", "p"), "rho")


@query("spearman_matrix", f"WITH {_SUPPLIER}, k AS (SELECT {_ranks('n')} AS a, {_ranks('q')} AS b, {_ranks('p')} AS c FROM r) SELECT 'n' AS a, 'q' AS b, count(*) AS n, round(corr(a, b), 6) AS rho FROM k UNION ALL SELECT 'n', 'p', count(*), round(corr(a, c), 6) FROM k UNION ALL SELECT 'q', 'p', count(*), round(corr(b, c), 6) FROM k")
def _(t: Tables) -> DataFrame:
    return _rounded(stats.spearman_matrix(_supplier(t), ["n", "q", "p"]), "rho")


@query(
    "simple_ols",
    f"""WITH {_SUPPLIER}, f AS (SELECT regr_count(q, n) AS n, regr_slope(q, n) AS slope, regr_intercept(q, n) AS intercept, regr_r2(q, n) AS r2, regr_sxx(q, n) AS sxx, regr_syy(q, n) AS syy FROM r)
SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 6) AS slope_error FROM f""",
)
def _(t: Tables) -> DataFrame:
    return _rounded(_rounded(stats.ols(_supplier(t), "n", "q"), "slope", "r2", "slope_error"), "intercept", places=4)


_CHI = """o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM orders GROUP BY ALL), e AS (SELECT x.a, y.b, x.r * y.c / n.n AS e, coalesce(o.o, 0) AS o, n.n FROM (SELECT a, sum(o) AS r FROM o GROUP BY 1) x, (SELECT b, sum(o) AS c FROM o GROUP BY 1) y, (SELECT sum(o) AS n FROM o) n LEFT JOIN o ON o.a = x.a AND o.b = y.b)"""


@query("chi2_rxc", "WITH " + _CHI.format(a="o_orderpriority", b="o_orderstatus") + " SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, CAST(max(n) AS BIGINT) AS n FROM e")
def _(t: Tables) -> DataFrame:
    return _rounded(stats.chi_square(t.orders, "o_orderpriority", "o_orderstatus"), "statistic")


@query("chi2_yates", "WITH " + _CHI.format(a="o_totalprice > 250000", b="o_orderstatus = 'F'") + " SELECT round(sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, CAST(max(n) AS BIGINT) AS n FROM e")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_totalprice") > 250000).alias("a"), (F.col("o_orderstatus") == "F").alias("b"))
    return _rounded(stats.chi_square(rows, "a", "b", yates=True), "statistic")


@query(
    "kruskal_h",
    f"""WITH v AS (SELECT o_orderpriority AS g, round(o_totalprice / 1000) AS v FROM orders), k AS (SELECT g, v, {_ranks('v')} AS r FROM v), s AS (SELECT g, sum(r) AS s, count(*) AS n FROM k GROUP BY 1),
t AS (SELECT sum(power(n, 3) - n) AS t FROM (SELECT count(*) AS n FROM v GROUP BY v)), n AS (SELECT count(*)::DOUBLE AS n FROM v)
SELECT round((12 / (n * (n + 1)) * (SELECT sum(s * s / n) FROM s) - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h, (SELECT count(*) - 1 FROM s) AS df, CAST(n AS BIGINT) AS n FROM n, t""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("v"))
    return _rounded(stats.kruskal(rows, "v", "o_orderpriority"), "h", places=4)


@query("signed_rank", f"WITH d AS (SELECT l_quantity - 25 AS d, abs(l_quantity - 25) AS a FROM lineitem WHERE l_quantity <> 25), k AS (SELECT d, {_ranks('a')} AS r FROM d) SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus FROM k")
def _(t: Tables) -> DataFrame:
    return stats.signed_rank(t.lineitem.select("l_quantity", F.lit(25.0).alias("y")), "l_quantity", "y")


@query("rank_sum", f"WITH k AS (SELECT o_orderstatus AS g, {_ranks('o_totalprice')} AS r FROM orders) SELECT count(*) FILTER (g = 'F') AS n_first, count(*) FILTER (g <> 'F') AS n_rest, sum(r) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2 AS u FROM k")
def _(t: Tables) -> DataFrame:
    return stats.rank_sum(t.orders, "o_totalprice", "o_orderstatus", "F")


@query(
    "sensitivity_sweep",
    f"""WITH {_SUPPLIER}, s AS (SELECT unnest([0.25, 0.5, 0.75, 0.9]) AS share), e AS (SELECT share, (SELECT quantile_cont(n, 1 - share) FROM r) AS ex, (SELECT quantile_cont(q, share) FROM r) AS ey FROM s)
SELECT CAST(share AS DOUBLE) AS share, count(*) FILTER (n <= ex) AS low, count(*) FILTER (q >= ey) AS high, count(*) FILTER (n <= ex AND q >= ey) AS "both", count(*) AS n, round(count(*) FILTER (n <= ex) * count(*) FILTER (q >= ey) / count(*), 6) AS expected FROM r, e GROUP BY share""".replace("(SELECT quantile_cont(n, 1 - share) FROM r)", "CASE share WHEN 0.25 THEN (SELECT quantile_cont(n, 0.75) FROM r) WHEN 0.5 THEN (SELECT quantile_cont(n, 0.5) FROM r) WHEN 0.75 THEN (SELECT quantile_cont(n, 0.25) FROM r) ELSE (SELECT quantile_cont(n, 0.1) FROM r) END").replace("(SELECT quantile_cont(q, share) FROM r)", "CASE share WHEN 0.25 THEN (SELECT quantile_cont(q, 0.25) FROM r) WHEN 0.5 THEN (SELECT quantile_cont(q, 0.5) FROM r) WHEN 0.75 THEN (SELECT quantile_cont(q, 0.75) FROM r) ELSE (SELECT quantile_cont(q, 0.9) FROM r) END"),
)
def _(t: Tables) -> DataFrame:
    return _rounded(stats.quantile_sweep(_supplier(t), "n", "q", [0.25, 0.5, 0.75, 0.9]), "expected")


@query("quantile_breaks", "WITH e AS (SELECT DISTINCT unnest([min(p_size), quantile_cont(p_size, 0.25), quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75), max(p_size)]) AS edge FROM part) SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INT) AS place, CAST(edge AS DOUBLE) AS edge FROM e")
def _(t: Tables) -> DataFrame:
    return stats.quantile_breaks(t.part, "p_size", 4)


@query("binomial_expected", "SELECT count(*) FILTER (a) AS low, count(*) FILTER (b) AS high, count(*) FILTER (a AND b) AS \"both\", round(count(*) FILTER (a) * count(*) FILTER (b) / count(*), 6) AS expected FROM (SELECT c_acctbal < 0 AS a, c_nationkey < 5 AS b FROM customer)")
def _(t: Tables) -> DataFrame:
    low, high = F.col("c_acctbal") < 0, F.col("c_nationkey") < 5
    return t.customer.agg(F.count_if(low).alias("low"), F.count_if(high).alias("high"), F.count_if(low & high).alias("both"), F.round(F.count_if(low) * F.count_if(high) / F.count("*"), 6).alias("expected"))


@query(
    "fleiss_kappa_ac1",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS k, count(*) AS n FROM events GROUP BY ALL), i AS (SELECT user_id, d, sum(n) AS r, sum(n * n) AS q FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT count(*) AS items, avg((q - r) / (r * (r - 1))) AS po, sum(r) AS total FROM i), s AS (SELECT k, sum(n) AS n, sum(n / r) AS p FROM c JOIN i USING (user_id, d) GROUP BY 1),
e AS (SELECT sum(power(n / total, 2)) AS fe, sum(p / items * (1 - p / items)) / (count(*) - 1) AS ge, count(*) AS k FROM s, o)
SELECT items, k AS categories, round(po, 6) AS observed, round((po - fe) / (1 - fe), 6) AS fleiss_kappa, round((po - ge) / (1 - ge), 6) AS gwet_ac1 FROM o, e""",
)
def _(t: Tables) -> DataFrame:
    counts = agreement.agreement_counts(t.events.withColumn("d", F.to_date("ts")), ["user_id", "d"], "event_type")
    return _rounded(agreement.agreement(counts, ["user_id", "d"], "event_type"), "observed", "fleiss_kappa", "gwet_ac1")


@query(
    "prf_scores",
    """WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars > 800), j AS (SELECT t.doc_id AS a, f.doc_id AS b FROM t FULL JOIN f ON t.doc_id = f.doc_id),
c AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def _(t: Tables) -> DataFrame:
    found = t.documents.where("n_chars > 800").join(t.labels, "doc_id")
    return _rounded(agreement.prf(t.labels.where("quality = 1"), found, ["doc_id"]), "precision", "recall", "f1")


@query("field_accuracy", "WITH j AS (SELECT l.quality, l.toxic, CASE WHEN d.n_chars > 800 THEN 1 WHEN d.n_chars > 200 THEN 0 END AS q, CASE WHEN d.lang = 'en' THEN 0 END AS x FROM labels l LEFT JOIN documents d USING (doc_id)) SELECT 'quality' AS field, count(quality) AS coded, count(q) AS \"both\", round(avg((quality = q)::INT), 6) AS accuracy, round(count(q) / count(quality), 6) AS coverage FROM j UNION ALL SELECT 'toxic', count(toxic), count(x), round(avg((toxic = x)::INT), 6), round(count(x) / count(toxic), 6) FROM j")
def _(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.when(F.col("n_chars") > 800, 1).when(F.col("n_chars") > 200, 0).alias("quality"), F.when(F.col("lang") == "en", 0).alias("toxic"))
    return _rounded(agreement.field_accuracy(t.labels, found, ["doc_id"], ["quality", "toxic"]), "accuracy", "coverage")


@query(
    "consensus_mode",
    """WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM events GROUP BY ALL), r AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS raters, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS rn FROM v)
SELECT user_id, event_type, votes, CAST(raters AS BIGINT) AS raters, 2 * votes > raters AS majority FROM r WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    return agreement.consensus(t.events, ["user_id"], "event_type", "event_id")


@query("majority_members", "WITH r AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS raters FROM lineitem GROUP BY 1), v AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, votes, raters FROM v JOIN r USING (l_orderkey) WHERE 2 * votes > raters")
def _(t: Tables) -> DataFrame:
    return agreement.majority_members(t.lineitem, ["l_orderkey"], "l_suppkey", "l_returnflag")
