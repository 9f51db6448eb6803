"""Joins, coverage against a reference, hierarchies, name resolution, dictionaries, incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import joins, resolve, summaries
from ledgerline.operators.rules import text_cascade
from ledgerline.plans.base import Tables, query
from ledgerline.streaming import incremental

#: Classes of a part by its name, the first that fits.
CLASSES = (("metal", "ring|bolt|gear"), ("small", "small|tiny"), ("coloured", "red|blue|green"))
CLASS_SQL = "CASE WHEN regexp_matches(lower(p_name), 'ring|bolt|gear') THEN 'metal' WHEN regexp_matches(lower(p_name), 'small|tiny') THEN 'small' WHEN regexp_matches(lower(p_name), 'red|blue|green') THEN 'coloured' ELSE 'other' END"


@query("classify_relationship", f"SELECT p_partkey, {CLASS_SQL} AS class FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text_cascade(F.col("p_name"), CLASSES, "other").alias("class"))


def _classified(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", text_cascade(F.col("p_name"), CLASSES, "other").alias("class"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))


_CLASSIFIED = f"c AS (SELECT l_orderkey, l_suppkey, {CLASS_SQL} AS class FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("relationship_by_item", f"WITH {_CLASSIFIED} SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.counted(_classified(t), ["class"]).withColumn("share", F.round("share", 6))


@query("relationship_by_parent", f"WITH {_CLASSIFIED}, d AS (SELECT DISTINCT l_orderkey, class FROM c) SELECT class, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.counted(_classified(t), ["class"], "l_orderkey").withColumn("share", F.round("share", 6))


@query(
    "relationship_by_country",
    f"""WITH {_CLASSIFIED}, d AS (SELECT DISTINCT n_name, class, l_orderkey FROM c JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT n_name AS country, class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY n_name), 6) AS share FROM d GROUP BY n_name, class""",
)
def _(t: Tables) -> DataFrame:
    suppliers = joins.lookup(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), t.nation.select("n_nationkey", F.col("n_name").alias("country")), ["n_nationkey"])
    rows = joins.lookup(_classified(t), suppliers, ["l_suppkey"])
    return summaries.counted(rows, ["country", "class"], "l_orderkey", within=["country"]).withColumn("share", F.round("share", 6))


@query("lookup_default", "SELECT c_custkey, coalesce(n_name, 'Unassigned') AS country FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return joins.lookup(rows, t.nation.where("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("country")), ["n_nationkey"], {"country": "Unassigned"}).drop("n_nationkey")


@query("zero_filled_counts", "SELECT n_name, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    counts = t.orders.where("o_totalprice > 400000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"))
    return joins.lookup(t.nation.select("n_nationkey", "n_name"), counts, ["n_nationkey"], {"orders": 0}).drop("n_nationkey")


@query(
    "role_playing_lookups",
    """SELECT o_orderkey, a.n_name AS customer_n_name, b.n_name AS home_n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = o_custkey % 25""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", (F.col("o_custkey") % 25).alias("home"))
    return joins.role_lookups(rows, t.nation, "n_nationkey", {"c_nationkey": "customer", "home": "home"}, ["n_name"]).drop("c_nationkey", "home")


@query(
    "prioritised_lookup",
    """WITH d AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS code, n_name AS name, n_regionkey AS region FROM nation),
s AS (SELECT s_suppkey, s_nationkey AS code, 'NATION_' || (s_nationkey + 1) % 25 AS name FROM supplier)
SELECT s_suppkey, coalesce(a.region, b.region) AS region FROM s LEFT JOIN d a ON a.code = s.code LEFT JOIN d b ON a.code IS NULL AND b.name = s.name""",
)
def _(t: Tables) -> DataFrame:
    dimension = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    facts = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("code_"), F.concat(F.lit("NATION_"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("name_"))
    facts = facts.withColumnRenamed("code_", "code").withColumnRenamed("name_", "name")
    return joins.prioritised_lookup(facts, dimension, ["code", "name"], "region").select("s_suppkey", "region")


@query(
    "upsert_recovered",
    """WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 14 <> 0 THEN 'X' END AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 7 = 0)
SELECT o.o_orderkey, coalesce(u.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(u.o_totalprice, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN u USING (o_orderkey)""",
)
def _(t: Tables) -> DataFrame:
    main = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    fresh = main.where("o_orderkey % 7 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 14 != 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return joins.upsert(main, fresh, ["o_orderkey"])


@query(
    "outer_compare",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.compared(a, b, ["k"], "n", ("customers", "suppliers"))


@query(
    "set_overlap",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_left, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS "both", (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_right""",
)
def _(t: Tables) -> DataFrame:
    a, b = (t.lineitem.where(c).select(F.col("l_partkey").alias("k")) for c in ("l_quantity > 45", "l_discount > 0.09"))
    return joins.overlap(a, b, ["k"])


@query("unstudied_entities", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(t: Tables) -> DataFrame:
    studied = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.known_minus(t.customer.select("c_custkey", "c_name"), studied, F.col("c_custkey"))


@query("topk_semi", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 5)")
def _(t: Tables) -> DataFrame:
    most = summaries.top(summaries.counted(t.lineitem, ["l_suppkey"], share=None), 5, "n", "l_suppkey")
    return joins.among(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), most, ["l_suppkey"])


@query("known_minus_flagged", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R'))")
def _(t: Tables) -> DataFrame:
    flagged = summaries.exclusive(t.lineitem, "l_partkey", F.col("l_returnflag") != "R").select(F.col("l_partkey").alias("p_partkey"))
    return joins.known_minus(t.part.select("p_partkey"), flagged, F.col("p_partkey"))


@query("duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return joins.duplicate_keys(t.orders, ["o_custkey"])


_COVER = "s AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')"


@query("coverage_by_group", f"WITH {_COVER} SELECT p_brand, count(*) AS known, count(l_partkey) AS studied, count(*) - count(l_partkey) AS not_studied, round(100.0 * count(l_partkey) / count(*), 6) AS coverage_percent FROM part LEFT JOIN s ON l_partkey = p_partkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    studied = t.lineitem.where("l_shipdate >= timestamp '2001-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return summaries.coverage(t.part, studied, "p_partkey", ["p_brand"]).withColumn("coverage_percent", F.round("coverage_percent", 6))


@query("coverage_summary", f"WITH {_COVER} SELECT count(*) AS known, count(l_partkey) AS studied, count(*) - count(l_partkey) AS not_studied, round(100.0 * count(l_partkey) / count(*), 6) AS coverage_percent FROM part LEFT JOIN s ON l_partkey = p_partkey")
def _(t: Tables) -> DataFrame:
    studied = t.lineitem.where("l_shipdate >= timestamp '2001-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return summaries.coverage(t.part, studied, "p_partkey").withColumn("coverage_percent", F.round("coverage_percent", 6))


@query(
    "exclusive_to_undersampled",
    """WITH low AS (SELECT s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY count(*), 1 LIMIT 12)
SELECT l_partkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING bool_and(s_nationkey IN (SELECT s_nationkey FROM low))""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey")
    low = rows.groupBy("s_nationkey").agg(F.count("*").alias("n")).orderBy("n", "s_nationkey").limit(12).select("s_nationkey", F.lit(True).alias("low"))
    return summaries.exclusive(joins.lookup(rows, low, ["s_nationkey"], {"low": False}), "l_partkey", F.col("low"))


@query("status_labels", "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'all' WHEN bool_or(l_returnflag = 'R') THEN 'some' ELSE 'none' END AS label FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return summaries.flagged(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", "all", "some", "none")


@query("realm_sensitivity", "SELECT CASE WHEN n_nationkey % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS realm, count(DISTINCT c_custkey) AS customers, count(DISTINCT n_nationkey) AS nations FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    realm = F.coalesce(F.when(F.col("n_nationkey") % 5 == 0, (F.col("n_regionkey") + 1) % 5), F.col("n_regionkey"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(realm.alias("realm")).agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("n_nationkey").alias("nations"))


def _tree(t: Tables) -> DataFrame:
    """Suppliers as a binary tree by number; every seventh has a group of its own."""
    key = F.col("s_suppkey")
    return t.supplier.select(key.alias("id"), F.floor(key / 2).cast("long").alias("parent"), F.when((key % 7 == 0) & (key > 0), F.concat(F.lit("g"), key.cast("string"))).otherwise("").alias("grp"), F.when(key < 4, "top").otherwise("low").alias("rank"), F.col("s_name").alias("name"))


_TREE = "t AS (SELECT s_suppkey AS id, s_suppkey // 2 AS parent, CASE WHEN s_suppkey % 7 = 0 AND s_suppkey > 0 THEN 'g' || s_suppkey END AS grp, CASE WHEN s_suppkey < 4 THEN 'top' ELSE 'low' END AS rank, s_name AS name FROM supplier)"


@query(
    "hierarchy_backfill",
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS at, grp, 0 AS d FROM t UNION ALL SELECT up.id, t.parent, p.grp, d + 1 FROM up JOIN t ON t.id = up.at JOIN t p ON p.id = t.parent WHERE up.grp IS NULL AND t.parent <> t.id AND d < 40)
SELECT id, first(grp ORDER BY d) FILTER (grp IS NOT NULL) AS grp FROM up GROUP BY id""",
)
def _(t: Tables) -> DataFrame:
    return resolve.backfill_from_parent(_tree(t), "id", "parent", ["grp"]).select("id", "grp")


@query(
    "hierarchy_rank",
    f"""WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS at FROM t UNION SELECT up.id, t.parent FROM up JOIN t ON t.id = up.at WHERE t.rank <> 'top')
SELECT up.id, min(t.name) AS top FROM up JOIN t ON t.id = up.at WHERE t.rank = 'top' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return resolve.rank_from_lineage(_tree(t), "id", "parent", "rank", "name", ["top"]).select("id", "top")


@query("earliest_year", "SELECT o.o_orderkey, least(year(o.o_orderdate), year(b.o_orderdate)) AS year FROM orders o LEFT JOIN orders b ON b.o_orderkey = o.o_orderkey // 3")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.floor(F.col("o_orderkey") / 3).cast("long").alias("original"), F.year("o_orderdate").alias("year"))
    return resolve.earliest_year(rows, "o_orderkey", "original", "year").select("o_orderkey", "year")


def _taxonomy(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two-word part names as accepted names; reversed ones as synonyms; tokens: full, reversed and abbreviated names by order."""
    name = F.concat_ws(" ", F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1)))
    parts = t.part.select("p_partkey", name.alias("name"))
    accepted = resolve.accepted_names(parts, "name", "p_partkey", "p_partkey", F.lit(True))
    first, second = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    synonyms = accepted.where("id % 2 = 0").select(F.concat_ws(" ", second, first).alias("key"), "id")
    turn = F.col("l_linenumber") % 4
    token = F.when(turn == 0, F.col("name")).when(turn == 1, F.concat_ws(" ", second, first)).when(turn == 2, F.concat(F.substr("name", F.lit(1), F.lit(1)), F.lit(". "), second)).otherwise("zzz unknown")
    tokens = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.initcap(token).alias("token"))
    return accepted, synonyms, tokens


_RESOLVED = """p AS (SELECT p_partkey, string_split(lower(p_name), ' ')[1] AS a, string_split(lower(p_name), ' ')[2] AS b FROM part),
acc AS (SELECT a || ' ' || b AS key, min(p_partkey) AS id, a, b FROM p GROUP BY a, b), syn AS (SELECT b || ' ' || a AS key, min(id) AS id FROM acc WHERE id % 2 = 0 GROUP BY 1),
tok AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN a || ' ' || b WHEN 1 THEN b || ' ' || a WHEN 2 THEN a[1] || '. ' || b ELSE 'zzz unknown' END AS key FROM lineitem JOIN p ON p_partkey = l_partkey),
d AS (SELECT DISTINCT * FROM tok), gen AS (SELECT DISTINCT l_orderkey, string_split(key, ' ')[1] AS g FROM d WHERE NOT key LIKE '_. %'),
abb AS (SELECT d.l_orderkey, d.key, count(*) AS n, count(g) AS m, first(acc.id ORDER BY CASE WHEN g IS NULL THEN 1 ELSE 0 END, acc.id) AS id FROM d JOIN acc ON d.key LIKE '_. %' AND d.key[1] = acc.a[1] AND substr(d.key, 4) = acc.b LEFT JOIN gen ON gen.l_orderkey = d.l_orderkey AND gen.g = acc.a GROUP BY ALL),
resolved AS (SELECT tok.l_orderkey, tok.key, CASE WHEN acc.id IS NOT NULL THEN 'accepted' WHEN syn.id IS NOT NULL THEN 'synonym' WHEN n IS NOT NULL THEN 'abbreviation' ELSE 'no_match' END AS method,
  CASE WHEN acc.id IS NOT NULL THEN 1.0 WHEN syn.id IS NOT NULL THEN 0.95 WHEN n = 1 OR m = 1 THEN 0.75 WHEN n IS NOT NULL THEN 0.55 ELSE 0.0 END::DOUBLE AS confidence, coalesce(acc.id, syn.id, abb.id) AS id
  FROM tok LEFT JOIN acc ON acc.key = tok.key LEFT JOIN syn ON syn.key = tok.key LEFT JOIN abb ON abb.l_orderkey = tok.l_orderkey AND abb.key = tok.key)"""


@query("resolve_precedence", f"WITH {_RESOLVED} SELECT method, confidence, count(*) AS tokens, CAST(sum(coalesce(id, 0)) AS BIGINT) AS id_sum FROM resolved GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    accepted, synonyms, tokens = _taxonomy(t)
    out = resolve.resolve_names(tokens, "token", "l_orderkey", accepted, synonyms)
    return out.groupBy("method", "confidence").agg(F.count("*").alias("tokens"), F.sum(F.coalesce("resolved_id", F.lit(0))).alias("id_sum"))


@query("review_queue", f"WITH {_RESOLVED} SELECT key AS token, method, count(*) AS n FROM resolved WHERE confidence < 0.6 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    accepted, synonyms, tokens = _taxonomy(t)
    queue = resolve.review_queue(resolve.resolve_names(tokens, "token", "l_orderkey", accepted, synonyms))
    return queue.groupBy(F.lower("token").alias("token"), "method").agg(F.count("*").alias("n"))


@query(
    "resolve_cells",
    f"""WITH {_RESOLVED}, names AS (SELECT key, id, a || ' ' || b AS name FROM acc) SELECT l_orderkey, string_agg(DISTINCT CAST(r.id AS VARCHAR), '; ' ORDER BY CAST(r.id AS VARCHAR)) AS ids,
  CASE WHEN count(r.id) = count(*) THEN 'Resolved' WHEN count(r.id) > 0 THEN 'Partially resolved' ELSE 'Unresolved' END AS status FROM (SELECT DISTINCT l_orderkey, key, id FROM resolved) r GROUP BY l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    from ledgerline.plans import analyses

    accepted, synonyms, tokens = _taxonomy(t)
    cells = tokens.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("token")), "; ").alias("cell")).withColumn("group", F.col("l_orderkey"))
    out = analyses.resolve_cells(cells, "l_orderkey", "cell", "group", accepted, synonyms)["cells"]
    return out.select("l_orderkey", F.when(F.col("ids") != "", F.col("ids")).alias("ids"), "status")


@query(
    "dictionary_match",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM u),
g AS (SELECT doc_id, x AS term FROM n UNION SELECT doc_id, x || ' ' || y FROM n UNION SELECT doc_id, x || ' ' || y || ' ' || z FROM n),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\pL]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT term, min(value) AS value FROM (SELECT w[1] || ' ' || w[2] AS term, item_id AS value FROM b UNION ALL SELECT w[3], item_id FROM b) WHERE length(term) >= 3 GROUP BY 1)
SELECT doc_id, term, value FROM g JOIN d USING (term)""",
)
def _(t: Tables) -> DataFrame:
    from ledgerline.functions.text import tokens

    words = t.benchmark.select("item_id", tokens("text").alias("w"))
    two = words.select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("term"), F.col("item_id").alias("value"))
    dictionary = two.unionByName(words.select(F.get("w", F.lit(2)).alias("term"), F.col("item_id").alias("value"))).where("term is not null")
    return resolve.dictionary_match(t.documents, "doc_id", ["text"], dictionary)


@query("complete_grid", "WITH c AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders WHERE o_totalprice > 490000 GROUP BY ALL) SELECT p, y, coalesce(n, 0) AS n FROM (SELECT DISTINCT p FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (p, y)")
def _(t: Tables) -> DataFrame:
    counts = t.orders.where("o_totalprice > 490000").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return joins.complete(counts, ["p", "y"], {"n": 0})


@query("cooccurrence_pairs", "WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joins.pairs_within(rows, "l_orderkey", "p_brand")


@query("incremental_new_rows", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type")
    return incremental.new_rows(rows, rows.where("event_type = 'click'"), ["event_id"]).drop("event_type")


@query("incremental_cache", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def _(t: Tables) -> DataFrame:
    known = t.orders.select("o_orderkey", F.year("o_orderdate").alias("year"))
    rows, _fresh = incremental.with_cache(t.orders.select("o_orderkey"), known.where("o_orderkey % 3 = 0"), "o_orderkey", "year", lambda misses: misses.join(known, "o_orderkey"))
    return rows


@query("incremental_checkpoints", "SELECT checkpoint, n AS rows, CAST(sum(n) OVER (ORDER BY checkpoint) AS BIGINT) AS done FROM (SELECT event_id // 1000 AS checkpoint, count(*) AS n FROM events GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    return incremental.checkpointed_counts(t.events, "event_id", 1000)


@query("retry_subset", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2')")
def _(t: Tables) -> DataFrame:
    return incremental.retryable(t.orders, "o_orderpriority", ["1", "2"]).select("o_orderkey")


@query("windowed_events", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return incremental.windowed(t.events, "ts", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("manifest_merge", "SELECT k AS item, arg_min(status, (p, o_orderkey)) AS status FROM (SELECT o_custkey AS k, o_orderkey, o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from ledgerline.operators.dedup import keep_first

    rows = t.orders.select(F.col("o_custkey").alias("item"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    best = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    return keep_first(rows, ["item"], [best, "o_orderkey"]).select("item", "status")


@query("derived_key_join", "SELECT regexp_replace(lower(a.c_name), '[^a-z0-9]', '', 'g') AS join_key, a.c_custkey AS c_custkey_x, b.c_custkey AS c_custkey_y FROM customer a JOIN customer b ON regexp_replace(lower(a.c_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(upper(b.c_name)), '[^a-z0-9]', '', 'g')")
def _(t: Tables) -> DataFrame:
    from ledgerline.functions.text import alnum_key

    right = t.customer.select(F.upper("c_name").alias("c_name"), "c_custkey")
    return joins.joined_on(t.customer.select("c_name", "c_custkey"), right, alnum_key("c_name")).select("join_key", "c_custkey_x", "c_custkey_y")


@query("first_existing_name", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN s_suppkey % 3 = 0 THEN 'alt-' || s_suppkey END AS file FROM supplier")
def _(t: Tables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    listing = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("file")).unionByName(t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("alt-"), key).alias("file")))
    return joins.first_existing(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", [F.col("s_name"), F.concat(F.lit("alt-"), key)], listing, "file").drop("s_name")


@query("skip_review", "SELECT p_partkey, CASE WHEN lower(p_name) = 'small ring' THEN false ELSE starts_with(lower(p_name), 'small') OR regexp_matches(lower(p_name), 'widget$') END AS skip FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", resolve.skip_review("p_name", protected=["small ring"], prefixes=["small"], patterns=["widget$"]).alias("skip"))


@query("usable_nodes", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('f', 'o') AND lower(o_orderpriority) IN ('1-urgent', '2-high') AND o_custkey % 5 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("state", F.when(F.col("o_custkey") % 5 == 0, "Misapplied").when(F.col("o_custkey") % 5 == 1, " "))
    return resolve.usable_nodes(rows, "o_orderstatus", "o_orderpriority", "state", ["f", "o"], ["1-urgent", "2-high"]).select("o_orderkey")


@query("coded_names", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X3' ELSE 'R' || n_regionkey END AS code FROM nation")
def _(t: Tables) -> DataFrame:
    letters = F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")
    names = t.nation.select("n_nationkey", F.concat(F.lit("The land of "), letters, F.lit(" country, far away")).alias("name"))
    dictionary = t.nation.select(F.concat(letters, F.lit(" country")).alias("term"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("value"))
    return resolve.coded(names, "name", {"the land of d country, far away": "X3"}, dictionary, "code").drop("name")
