"""Scans and sinks: tables written to the session's shared folder in some form and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import dedup, extract, resolve, rules, stats
from ledgerline.plans.base import Tables, query
from ledgerline.sources import readers, writers


def _written(df: DataFrame, path: str) -> None:
    """The column ``line`` in the order of ``place`` as one text file: for tables that are small by nature."""
    df.orderBy("place").select("line").coalesce(1).write.mode("overwrite").text(path)


@query("files_union", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey >= 2 THEN n_regionkey END AS region FROM nation")
def _(t: Tables) -> DataFrame:
    """Two exports, one without a column and with another name for one."""
    folder = t.scratch("union")
    old = t.nation.where("n_regionkey < 2").select("n_nationkey", F.col("n_name").alias("Nation.Name"))
    writers.write_csv(old, f"{folder}/old", quote_all=True)
    writers.write_csv(t.nation.where("n_regionkey >= 2").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region")), f"{folder}/new")
    both = readers.union_scan(t.spark, f"{folder}/*/*.csv", rename={"Nation.Name": "n_name"}, source="file")
    return both.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("region").cast("int").alias("region"))


@query("files_shards", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'a' ELSE 'b' END AS origin FROM customer")
def _(t: Tables) -> DataFrame:
    """Overlapping shards: of a customer in both, the first shard's row stays."""
    folder = t.scratch("shards")
    rows = t.customer.select("c_custkey", "c_acctbal")
    writers.write_csv(rows.where("c_acctbal > 0").select("c_custkey", F.lit("a").alias("origin")), f"{folder}/a")
    writers.write_csv(rows.select("c_custkey", F.lit("b").alias("origin")), f"{folder}/b")
    return readers.shards(t.spark, f"{folder}/*/*.csv", ["c_custkey"], ["origin"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "origin")


@query("files_cells_with_line_breaks", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t: Tables) -> DataFrame:
    """Whole texts, of any length and with line breaks and quotes, through a delimited file, of which two columns are read."""
    path = t.scratch("cells")
    writers.write_csv(t.documents.select("doc_id", "lang", "text"), path, quote_all=True)
    rows = readers.csv(t.spark, readers.first_path(t.spark, [f"{path}-none", path]), columns=["doc_id", "text", "absent"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


@query("files_preamble", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    """Rows after sixteen lines, some of which look like rows."""
    path = t.scratch("preamble")
    head = t.spark.range(16).select((F.col("id") - 17).alias("place"), F.when(F.col("id") == 3, "s_suppkey,s name").otherwise(F.concat(F.col("id").cast("string"), F.lit(",about"))).alias("line"))
    title = t.spark.createDataFrame([(-1, "s_suppkey,s name")], "place long, line string")
    _written(head.unionByName(title).unionByName(t.supplier.select(F.col("s_suppkey").cast("long").alias("place"), F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("line"))), path)
    rows = readers.after_preamble(t.spark, path, 16)
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s name").alias("s_name"))


@query("files_lines", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS line_no, s_name AS line FROM supplier")
def _(t: Tables) -> DataFrame:
    path = t.scratch("lines")
    _written(t.supplier.select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("line")), path)
    return readers.lines(t.spark, path).select("line_no", "line")


@query("files_records", "SELECT CAST(n_nationkey AS INT) AS number, n_name AS title, '10.1/' || n_nationkey AS doi FROM nation")
def _(t: Tables) -> DataFrame:
    """A whole text of numbered records, split before each of them."""
    path = t.scratch("records")
    one = F.concat(F.col("n_nationkey").cast("string"), F.lit(". Title: "), F.col("n_name"), F.lit("\nDOI: 10.1/"), F.col("n_nationkey").cast("string"))
    text = t.nation.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("r")))), lambda x: x["r"]), "\n\n").alias("value"))
    text.write.mode("overwrite").text(path)
    whole = readers.whole_texts(t.spark, path)
    out = extract.records(whole, "text", r"\n\n(?=\d+\.\s)", {"number": r"^(\d+)\.", "title": r"Title: (.*)", "doi": r"DOI: (\S+)"})
    return out.select(F.col("number").cast("int").alias("number"), "title", "doi")


@query("files_json_lines", "SELECT event_id, event_type, value FROM events WHERE value > 50")
def _(t: Tables) -> DataFrame:
    """Lines of JSON, twice: all rows, then added ones; and the delimited subset of those that a condition holds for."""
    path = t.scratch("twin")
    rows = t.events.select("event_id", "event_type", "value")
    writers.write_twin(rows.where("event_id % 2 = 0"), path, "value > 50")
    writers.append_jsonl(rows.where("event_id % 2 = 1"), f"{path}/jsonl")
    every = readers.jsonl(t.spark, f"{path}/jsonl", "event_id long, event_type string, value double").where("value > 50")
    subset = readers.csv(t.spark, f"{path}/positive", schema="event_id long, event_type string, value double")
    return every.where("event_id % 2 = 1").unionByName(subset)


_MARK = "CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discount' END"


@query("files_kept_and_rejected", f"SELECT coalesce({_MARK}, 'kept') AS sink, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Both sinks read back: no row is in both."""
    path = t.scratch("filtered")
    cascade = rules.FilterCascade([("returned", F.col("l_returnflag") == "R"), ("discount", F.col("l_discount") > 0.08)])
    cascade.apply(t.lineitem.select("l_returnflag", "l_discount", "l_quantity"))
    writers.write_kept_and_rejected(cascade.marked, "filter_reason", f"{path}/kept", f"{path}/rejected")
    kept = t.spark.read.parquet(f"{path}/kept").select(F.lit("kept").alias("sink"), "l_quantity")
    both = kept.unionByName(t.spark.read.parquet(f"{path}/rejected").select(F.col("filter_reason").alias("sink"), "l_quantity"))
    return both.groupBy("sink").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    "files_audit",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P') SELECT 'usable' AS removed_by, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'customer', count(*) FROM a WHERE r > 1""",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("audit")
    stages = [dedup.Stage("usable", keep=F.col("o_orderstatus") != "P"), dedup.Stage("customer", key=F.col("o_custkey"))]
    removed = dedup.DedupPipeline(stages, ["o_orderkey"]).run(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"))[1]
    writers.write_audit(removed, path)
    return t.spark.read.parquet(path).groupBy("removed_by").agg(F.count("*").alias("n"))


@query("files_settings", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = t.scratch("settings")
    t.spark.createDataFrame([(json.dumps({"least": 300000, "statuses": ["F", "O"]}),)], "value string").write.mode("overwrite").text(path)
    settings = readers.config(t.spark, path)
    return t.orders.where((F.col("o_totalprice") > settings["least"]) & F.col("o_orderstatus").isin(*settings["statuses"])).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("files_report", "SELECT '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '| n_name | n_regionkey |'")
def _(t: Tables) -> DataFrame:
    path = t.scratch("report")
    writers.write_report(t.nation.where("n_regionkey = 1").select("n_name", "n_regionkey"), path, "Nations")
    return t.spark.read.text(path).where(F.col("value").startswith("| ")).select(F.col("value").alias("line"))


@query("files_manifest", "SELECT count(*) AS rows, 'struct<n_nationkey:int,n_name:string>' AS schema, sha256('{\"seed\": 1}') AS hash FROM nation")
def _(t: Tables) -> DataFrame:
    path = t.scratch("manifest")
    writers.manifest(t.nation.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), path, {"seed": 1})
    return readers.jsonl(t.spark, path, "rows long, schema string, hash string")


@query("files_memoised", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Made once for its version; the second call, which would make nothing, reads what the first wrote."""
    path = t.scratch("memo")
    readers.memoised(t.spark, path, "v1", lambda: t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return readers.memoised(t.spark, path, "v1", lambda: t.nation.limit(0)).select("n_regionkey", "n")


@query("files_documents", "SELECT r_regionkey, r_name || chr(10) AS text, 'ok' AS status FROM region")
def _(t: Tables) -> DataFrame:
    """A folder of plain texts, one for each region."""
    path = t.scratch("texts")
    t.region.select("r_regionkey", "r_name").write.mode("overwrite").partitionBy("r_regionkey").text(path)
    out = readers.documents(t.spark, f"{path}/*/*.txt")
    return out.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("r_regionkey"), "text", "status")


@query("files_features", "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, CAST(NULL AS VARCHAR) AS continent FROM nation")
def _(t: Tables) -> DataFrame:
    path = t.scratch("features")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")).alias("properties"))
    t.nation.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).write.mode("overwrite").text(path)
    return readers.feature_attributes(t.spark, path, ["code", "name", "continent"])


@query("paged_source", "SELECT r_regionkey AS region, CAST(p AS INT) AS page, r_regionkey * 10 + p AS value FROM region, range(3) u(p)")
def _(t: Tables) -> DataFrame:
    """Three pages for every key, from a fetcher that answers without a network."""
    fetch = lambda key, page: ([(key, page or 0, key * 10 + (page or 0))], (page or 0) + 1 if (page or 0) < 2 else None)
    keys = t.region.select(F.col("r_regionkey").cast("long").alias("r_regionkey"))
    return readers.pages(fetch, "region long, page int, value long", keys, "r_regionkey")


@query("profile_columns", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS rank, CAST(NULL AS VARCHAR) AS year FROM part")
def _(t: Tables) -> DataFrame:
    """The export's own profile is found by its columns; what it lacks is null."""
    profiles = {"plain": {"id": "taxonID", "name": "canonicalName"}, "parts": {"id": "p_partkey", "name": "p_name", "rank": "p_type", "year": "p_year"}}
    return resolve.normalised(t.part, profiles)


@query("columns_by_name", "SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS kind FROM part")
def _(t: Tables) -> DataFrame:
    """Columns found by other spellings of their names and by words in them; every text squished in lower case."""
    rows = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" \t")).alias("Part.Name"), F.col("p_type").alias("type of part"))
    name = readers.pick_column(rows.columns, ["title", "part name"])
    kind = readers.find_columns(rows.columns, {"kind": ["type", "part"]})["kind"]
    return T.squish_all(rows.select("p_partkey", F.col(f"`{name}`").alias("name"), F.col(f"`{kind}`").alias("kind")))


@query("stripped_suffixes", "SELECT p_partkey, p_name AS given, p_name AS guessed FROM part")
def _(t: Tables) -> DataFrame:
    """Authors after a name: known ones, and ones that only look like authors."""
    author = F.concat(F.lit("(L.) "), "p_brand")
    full = F.concat("p_name", F.lit(" "), author)
    return t.part.select("p_partkey", T.strip_suffix(full, author).alias("given"), T.strip_suffix(full, F.lit(None).cast("string")).alias("guessed"))


@query("quality_report", "SELECT CASE WHEN count(*) > count(DISTINCT o_orderkey) THEN 'FAIL' WHEN count(*) FILTER (o_orderstatus = 'P') >= 0.5 * count(*) THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, count(*) AS rows FROM orders")
def _(t: Tables) -> DataFrame:
    row = t.orders.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("o_orderkey")).alias("twice"), (100.0 * F.avg((F.col("o_orderstatus") == "P").cast("int"))).alias("missing")).first()
    report = writers.qa_report({"rows": row["rows"]}, {"o_orderstatus": row["missing"]}, row["twice"])
    return t.spark.createDataFrame([(report["status"], report["rows"])], "status string, rows long")


@query(
    "binomial_test",
    """WITH k AS (SELECT count(*) FILTER (s_acctbal < 0) AS k, count(*) AS n FROM supplier), p AS (SELECT i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.25) + (n - i) * ln(0.75)) AS p, k, n FROM k, range(0, (SELECT n + 1 FROM k)) u(i))
SELECT k AS hits, n, round(sum(p) FILTER (p <= (SELECT p * (1 + 1e-7) FROM p WHERE i = k)), 6) AS p FROM p GROUP BY k, n""",
)
def _(t: Tables) -> DataFrame:
    row = t.supplier.agg(F.count_if(F.col("s_acctbal") < 0).alias("k"), F.count("*").alias("n")).first()
    return t.spark.createDataFrame([(row["k"], row["n"], round(stats.binomial_two_sided(row["k"], row["n"], 0.25), 6))], "hits long, n long, p double")
