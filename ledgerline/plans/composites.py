"""The composite analyses on the driver's tables, with SQL for their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans import analyses
from ledgerline.plans.base import Tables, query


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    part = t.part.select("p_partkey", "p_brand", "p_type", F.col("p_size"))
    return part, t.lineitem.where("l_shipdate >= timestamp '2001-01-01'").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")


@query(
    "analysis_coverage_levels",
    """WITH s AS (SELECT DISTINCT p.* FROM lineitem JOIN part p ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-01-01')
SELECT 'p_partkey' AS level, (SELECT count(DISTINCT p_partkey) FROM part) AS known, count(DISTINCT p_partkey) AS studied, (SELECT count(DISTINCT p_partkey) FROM part) - count(DISTINCT p_partkey) AS not_studied, round(100.0 * count(DISTINCT p_partkey) / (SELECT count(DISTINCT p_partkey) FROM part), 6) AS coverage_percent FROM s
UNION ALL SELECT 'p_size', (SELECT count(DISTINCT p_size) FROM part), count(DISTINCT p_size), (SELECT count(DISTINCT p_size) FROM part) - count(DISTINCT p_size), round(100.0 * count(DISTINCT p_size) / (SELECT count(DISTINCT p_size) FROM part), 6) FROM s""",
)
def _(t: Tables) -> DataFrame:
    known, studied = _parts(t)
    return analyses.coverage_levels(known, studied, ["p_partkey", "p_size"], "p_brand")["summary"].withColumn("coverage_percent", F.round("coverage_percent", 6))


@query("analysis_understudied", "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known, studied = _parts(t)
    text = lambda d: d.withColumn("k", F.col("p_partkey").cast("string"))
    return analyses.understudied(text(known), text(studied), "k", ["p_brand"])["by_p_brand"]


@query("analysis_group_share", "SELECT count(DISTINCT o_custkey) AS \"all\", count(DISTINCT o_custkey) FILTER (o_totalprice > 400000) AS \"group\", round(100.0 * count(DISTINCT o_custkey) FILTER (o_totalprice > 400000) / count(DISTINCT o_custkey), 6) AS percent FROM orders")
def _(t: Tables) -> DataFrame:
    return analyses.group_share(t.orders, "o_custkey", F.col("o_totalprice") > 400000, ["o_orderpriority"])["share"].withColumn("percent", F.round("percent", 6))


@query(
    "analysis_priority_overlap",
    """WITH r AS (SELECT s_suppkey, s_acctbal, count(l_orderkey) AS n, s_nationkey FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL), e AS (SELECT quantile_cont(n, 0.5) AS e, quantile_cont(s_acctbal, 0.5) AS p FROM r)
SELECT count(*) AS n, count(*) FILTER (n <= e) AS low, count(*) FILTER (s_acctbal >= p) AS high, count(*) FILTER (n <= e AND s_acctbal >= p) AS "both", round(count(*) FILTER (n <= e) * count(*) FILTER (s_acctbal >= p) / count(*), 6) AS expected FROM r, e""",
)
def _(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("effort"))
    rows = t.supplier.join(counts, "s_suppkey", "left").fillna(0, ["effort"])
    return analyses.priority_overlap(rows, "s_suppkey", "effort", "s_acctbal", 0.5, "s_nationkey")["summary"].withColumn("expected", F.round("expected", 6))


@query(
    "analysis_lineage_tables",
    """WITH c AS (SELECT l_partkey, l_suppkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), m AS (SELECT l_partkey, s_nationkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(n) DESC, s_nationkey) AS r FROM c GROUP BY l_partkey, s_nationkey)
SELECT l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey, (SELECT s_nationkey FROM m WHERE m.l_partkey = c.l_partkey AND r = 1) AS s_nationkey FROM c GROUP BY l_partkey""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", "s_nationkey")
    return analyses.lineage_tables(rows, "l_partkey", ["s_nationkey"], ["l_suppkey"])


@query("analysis_association", "WITH k AS (SELECT c_nationkey FROM (SELECT c_nationkey, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1) WHERE r <= 4) SELECT c_nationkey, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM k) GROUP BY c_nationkey, c_mktsegment")
def _(t: Tables) -> DataFrame:
    return analyses.association(t.customer, "c_nationkey", "c_mktsegment", 4)["cells"].withColumn("share", F.round("share", 6))


@query("analysis_link_places", "SELECT n_nationkey, n_name, n_regionkey, count(DISTINCT c_custkey) AS study_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey < 20 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    place = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("(Northern) NATION_"), F.col("c_nationkey").cast("string"), F.lit(" province; 12"))).otherwise("nowhere")
    rows = t.customer.select("c_custkey", F.regexp_replace(place, "Northern", "").alias("cell"))
    return analyses.link_places(rows, "c_custkey", "cell", t.nation, "n_nationkey", "n_name")["counts"]


@query(
    "analysis_enrich_places",
    """WITH o AS (SELECT c_nationkey AS n_nationkey, year(o_orderdate) AS year, max(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000 GROUP BY ALL),
l AS (SELECT n_nationkey, arg_max(value, (year, value)) AS v, max(year) AS y FROM o GROUP BY 1) SELECT n_nationkey, n_name, v AS price, CAST(y AS INT) AS price_year FROM nation LEFT JOIN l USING (n_nationkey)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.where("o_totalprice > 450000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    yearly = rows.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("value"))
    return analyses.enrich_places(t.nation.select("n_nationkey", "n_name"), "n_nationkey", {"price": yearly}, "year", "value")


@query("analysis_multi_label_curve", "WITH c AS (SELECT w AS label, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1) SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INT) AS place, CAST(sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c), 6) AS running_share FROM c")
def _(t: Tables) -> DataFrame:
    suite = analyses.multi_label_suite(t.part, "p_partkey", F.split("p_name", " "), "p_brand", "p_size")
    return suite["curve"].withColumn("running_share", F.round("running_share", 6))


@query("analysis_multi_label_pairs", "WITH c AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT x.w AS a, y.w AS b, count(*) AS n FROM c x JOIN c y ON x.p_partkey = y.p_partkey AND x.w < y.w GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return analyses.multi_label_suite(t.part, "p_partkey", F.split("p_name", " "), "p_brand", "p_size")["pairs"]


@query("analysis_by_group", "SELECT c_mktsegment AS of_group, c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL UNION ALL SELECT 'all', c_nationkey, count(*) FROM customer GROUP BY c_nationkey")
def _(t: Tables) -> DataFrame:
    from ledgerline.operators.summaries import counted

    return analyses.by_group(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY"], lambda d: {"counts": counted(d, ["c_nationkey"], share=None)})["counts"]


@query("analysis_plot_levels", "WITH s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'), k AS (SELECT p_brand, count(*) AS known, count(l_partkey) AS studied FROM part LEFT JOIN s ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, known, 'studied' AS level, studied AS n, round(100.0 * studied / known, 6) AS percent FROM k UNION ALL SELECT p_brand, known, 'not_studied', known - studied, round(100.0 * (known - studied) / known, 6) FROM k")
def _(t: Tables) -> DataFrame:
    from ledgerline.operators.summaries import coverage

    known, studied = _parts(t)
    return analyses.plot_levels(coverage(known, studied, "p_partkey", ["p_brand"]), "p_brand").withColumn("percent", F.round("percent", 6))


@query("analysis_quality", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS ids, count(*) FILTER (o_custkey IS NULL) AS no_id FROM orders")
def _(t: Tables) -> DataFrame:
    return analyses.quality_checks(t.orders, "o_custkey", ["o_orderstatus"], ["o_orderstatus"])["profile"]


@query("analysis_sample")
def _(t: Tables) -> DataFrame:
    return analyses.draw_sample(t.documents.select("doc_id", "lang"), 60, ["lang"], "doc_id", "s", t.labels.where("toxic = 1"), shared=20)


def _effort(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("effort"))
    return t.supplier.join(counts, "s_suppkey", "left").fillna(0, ["effort"]).withColumn("area", F.col("s_nationkey") + 1.0)


def _robustness(t: Tables) -> analyses.Results:
    return analyses.robustness(_effort(t), "s_suppkey", "effort", "s_acctbal", "area", "s_nationkey")


_EFFORT = "r AS (SELECT s_suppkey, s_acctbal, s_nationkey, s_nationkey + 1.0 AS area, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"
_TILES = "k AS (SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS a FROM r), t AS (SELECT *, CAST(1 + (r > 1 + (a - 1) / 4)::INT + (r > 1 + 2 * (a - 1) / 4)::INT + (r > 1 + 3 * (a - 1) / 4)::INT AS INT) AS tile FROM k)"


@query("analysis_robustness", f"WITH {_EFFORT}, {_TILES} SELECT tile, count(*) AS n, median(n) AS median, round(avg(n), 6) AS mean FROM t GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _robustness(t)["quartiles"].withColumn("mean", F.round("mean", 6))


def _midrank(c: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0)"


@query(
    "analysis_robustness_test",
    f"""WITH {_EFFORT}, {_TILES}, g AS (SELECT tile, n, {_midrank("n")} AS k FROM t), s AS (SELECT tile, sum(k) AS s, count(*) AS c FROM g GROUP BY 1), x AS (SELECT sum(power(c, 3) - c) AS x FROM (SELECT count(*) AS c FROM t GROUP BY n)), z AS (SELECT count(*)::DOUBLE AS z FROM t)
SELECT round((12 / (z * (z + 1)) * (SELECT sum(s * s / c) FROM s) - 3 * (z + 1)) / (1 - x / (z * z * z - z)), 5) AS h, (SELECT count(*) - 1 FROM s) AS df, CAST(z AS BIGINT) AS n FROM z, x""",
)
def _(t: Tables) -> DataFrame:
    return _robustness(t)["quartile_test"].withColumn("h", F.round("h", 5))


@query("analysis_robustness_regions", f"WITH {_EFFORT}, k AS (SELECT s_nationkey, {_midrank('n', 's_nationkey')} AS a, {_midrank('s_acctbal', 's_nationkey')} AS b FROM r) SELECT s_nationkey, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _robustness(t)["regions"].withColumn("rho", F.round("rho", 6))


@query("analysis_robustness_density", f"WITH {_EFFORT}, d AS (SELECT 1000.0 * n / area AS x, 1000.0 * s_acctbal / area AS y FROM r), k AS (SELECT {_midrank('x')} AS a, {_midrank('y')} AS b FROM d) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k")
def _(t: Tables) -> DataFrame:
    return _robustness(t)["density"].withColumn("rho", F.round("rho", 6))


@query(
    "analysis_robustness_model",
    f"""WITH {_EFFORT}, l AS (SELECT CASE WHEN s_acctbal > -1 THEN log10(s_acctbal + 1) END AS x, log10(n + 1) AS y FROM r), f AS (SELECT regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM l)
SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 5) AS intercept, round(r2, 6) AS r2, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 6) AS slope_error FROM f""",
)
def _(t: Tables) -> DataFrame:
    out = _robustness(t)["model"]
    return out.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("slope_error", 6).alias("slope_error"))


@query("analysis_missing", "SELECT 'o_orderstatus' AS \"column\", count(*) AS rows, count(*) FILTER (o_orderstatus IS NULL OR trim(o_orderstatus) = '') AS missing, round(100.0 * count(*) FILTER (o_orderstatus IS NULL OR trim(o_orderstatus) = '') / count(*), 6) AS missing_percent FROM orders")
def _(t: Tables) -> DataFrame:
    return analyses.quality_checks(t.orders, "o_custkey", ["o_orderstatus"])["missing"].withColumn("missing_percent", F.round("missing_percent", 6))


@query("analysis_statuses", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2")
def _(t: Tables) -> DataFrame:
    return analyses.quality_checks(t.orders, "o_custkey", ["o_orderstatus"], ["o_orderstatus"])["statuses"]


@query("analysis_duplicates", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return analyses.quality_checks(t.orders, "o_custkey", ["o_orderstatus"])["duplicates"]


_STUDIED = "s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')"


@query("analysis_coverage_by_group", f"WITH {_STUDIED} SELECT p_brand, count(DISTINCT p_partkey) AS known, count(DISTINCT l_partkey) AS studied, count(DISTINCT p_partkey) - count(DISTINCT l_partkey) AS not_studied, round(100.0 * count(DISTINCT l_partkey) / count(DISTINCT p_partkey), 6) AS coverage_percent FROM part LEFT JOIN s ON l_partkey = p_partkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    known, studied = _parts(t)
    return analyses.coverage_levels(known, studied, ["p_partkey"], "p_brand")["p_partkey_by_p_brand"].withColumn("coverage_percent", F.round("coverage_percent", 6))


@query("analysis_most_studied", "SELECT l_partkey AS p_partkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100")
def _(t: Tables) -> DataFrame:
    known, studied = _parts(t)
    return analyses.coverage_levels(known, studied, ["p_partkey"], "p_brand")["most_studied"]


def _score(t: Tables) -> analyses.Results:
    """Labels of quality as truth, long documents as what was found; event types of a user's days as ratings."""
    truth = t.labels.where("quality = 1").select(F.lit("all").alias("stage"), "doc_id", "quality")
    found = t.documents.where("n_chars > 800").join(t.labels.select("doc_id"), "doc_id").select(F.lit("all").alias("stage"), "doc_id", F.lit(1).alias("quality"))
    ratings = t.events.select(F.lit("type").alias("field"), "user_id", "event_type", "event_id")
    return analyses.score(truth, found, ratings, ["doc_id"], ["stage"], ["quality"], ["user_id"], "field", "event_type", "event_id")


_SCORED = "t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT DISTINCT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars > 800)"


@query("analysis_score_missed", f"WITH {_SCORED} SELECT 'all' AS stage, doc_id FROM t WHERE doc_id NOT IN (SELECT doc_id FROM f)")
def _(t: Tables) -> DataFrame:
    return _score(t)["missed"]


@query("analysis_score_wrong", f"WITH {_SCORED} SELECT 'all' AS stage, doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def _(t: Tables) -> DataFrame:
    return _score(t)["wrong"]


@query(
    "analysis_score_agreement",
    """WITH c AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL), i AS (SELECT user_id, sum(n) AS r, sum(n * n) AS q FROM c GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT count(*) AS items, avg((q - r) / (r * (r - 1))) AS po, sum(r) AS total FROM i), s AS (SELECT k, sum(n) AS n, sum(n / r) AS p FROM c JOIN i USING (user_id) GROUP BY 1),
e AS (SELECT sum(power(n / total, 2)) AS fe, sum(p / items * (1 - p / items)) / (count(*) - 1) AS ge, count(*) AS k FROM s, o)
SELECT 'type' AS field, items, k AS categories, round(po, 6) AS observed, round((po - fe) / (1 - fe), 6) AS fleiss_kappa, round((po - ge) / (1 - ge), 6) AS gwet_ac1 FROM o, e""",
)
def _(t: Tables) -> DataFrame:
    out = _score(t)["agreement"]
    return out.select("field", "items", "categories", *(F.round(c, 6).alias(c) for c in ("observed", "fleiss_kappa", "gwet_ac1")))


@query("analysis_staged_extraction")
def _(t: Tables) -> DataFrame:
    return analyses.staged_extraction(t.documents, "doc_id", "text", "^[A-E]", 800, 100, r"\b[A-Z][a-z]{4,}\b", "thing")["entities"]


@query("analysis_heal_rows", "SELECT p_partkey, CAST(1 AS BIGINT) AS record, '10.' || p_partkey AS doi, string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[-1] AS name, p_type AS type, p_brand AS brand FROM part")
def _(t: Tables) -> DataFrame:
    """Lines that begin with a part number, with names broken over lines, as rows of four columns."""
    text = F.concat_ws("\n", F.concat(F.lit("10."), F.col("p_partkey").cast("string"), F.lit("|"), F.substring_index("p_name", " ", 1)), F.concat(F.substring_index("p_name", " ", -1), F.lit("|"), F.col("p_type"), F.lit("|"), F.col("p_brand")))
    lines = t.part.select("p_partkey", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return analyses.heal_rows(lines, "p_partkey", "pos", "line", r"^10\.", ["doi", "name", "type", "brand"], r"^10\.", 0, 1)["table"]
