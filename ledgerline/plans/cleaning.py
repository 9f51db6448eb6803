"""Deduplication with a ledger, filters with reasons, repair of rows, standardisation, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.functions import text as T
from ledgerline.operators import dedup, nested, rules
from ledgerline.plans.base import Tables, query

#: The library's own key: lower case, white space squeezed, punctuation dropped.
KEY = "trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[[:punct:]]', '', 'g'))"


def _order() -> list:
    return ["source", F.desc("n_chars"), "doc_id"]


RANKED = f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY source, n_chars DESC, doc_id) AS rn FROM documents"


@query("dedup_text_keep_first", f"SELECT doc_id, source, n_chars FROM ({RANKED}) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return dedup.keep_first(t.documents.select("doc_id", "source", "n_chars", T.dedup_key("text").alias("k")), ["k"], _order()).select("doc_id", "source", "n_chars")


@query("dedup_removed_audit", f"SELECT doc_id, source, CAST(rn AS INT) AS dup_rank FROM ({RANKED}) WHERE rn > 1")
def _(t: Tables) -> DataFrame:
    return dedup.removed_rows(t.documents.select("doc_id", "source", "n_chars", T.dedup_key("text").alias("k")), ["k"], _order()).select("doc_id", "source", "dup_rank")


def _pipeline(t: Tables) -> tuple[dedup.DedupPipeline, DataFrame]:
    """Four stages over documents and the titles of pages: usable text, text, language, letters; keys are hashes of whole normalised texts."""
    length = F.length("body").alias("length")
    plain = F.trim(F.regexp_replace(F.lower("body"), "[^a-z0-9 ]", ""))
    keys = [length, F.sha2(plain, 256).alias("plain"), F.when(F.length(plain) >= 15, F.sha2(F.replace(plain, F.lit(" ")), 256)).alias("letters")]
    docs = t.documents.select(F.lit(1).alias("rank"), F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang")
    titles = t.pages.select(F.lit(2).alias("rank"), F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("body"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"))
    # Only lengths and hashes travel, not the texts.
    both = docs.unionByName(titles).select("rank", "id", "lang", *keys)
    stages = [
        dedup.Stage("usable", keep=F.col("length") >= 20),
        dedup.Stage("text", key=F.col("plain")),
        dedup.Stage("language", keep=F.col("lang").isin("en", "fr", "de")),
        dedup.Stage("letters", key=F.col("letters")),
    ]
    return dedup.DedupPipeline(stages, ["rank", F.desc("length"), "id"]), both


_PIPELINE = """base AS (SELECT 1 AS rank, doc_id AS id, text AS body, lang FROM documents
  UNION ALL SELECT 2, page_id, regexp_extract(html, '<title>(.*?)</title>', 1), regexp_extract(html, 'lang="([a-z]*)"', 1) FROM pages),
s1 AS (SELECT *, trim(regexp_replace(lower(body), '[^a-z0-9 ]', '', 'g')) AS k FROM base WHERE length(body) >= 20),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, length(body) DESC, id) AS rn FROM s1) WHERE rn = 1),
s3 AS (SELECT * FROM s2 WHERE lang IN ('en', 'fr', 'de')),
s4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(k) >= 15 THEN replace(k, ' ', '') ELSE 'none ' || rank || ' ' || id END ORDER BY rank, length(body) DESC, id) AS rm FROM s3) WHERE rm = 1)"""


@query(
    "dedup_stage_ledger",
    f"""WITH {_PIPELINE}, n AS (SELECT (SELECT count(*) FROM base) AS n0, (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM s2) AS n2, (SELECT count(*) FROM s3) AS n3, (SELECT count(*) FROM s4) AS n4)
SELECT CAST(1 AS INT) AS step, 'usable' AS stage, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS removed FROM n UNION ALL SELECT 2, 'text', n1, n2, n1 - n2 FROM n
UNION ALL SELECT 3, 'language', n2, n3, n2 - n3 FROM n UNION ALL SELECT 4, 'letters', n3, n4, n3 - n4 FROM n""",
)
def _(t: Tables) -> DataFrame:
    pipeline, rows = _pipeline(t)
    return pipeline.run(rows)[2].drop("note")


@query("dedup_pipeline_kept", f"WITH {_PIPELINE} SELECT CAST(rank AS INT) AS rank, id, lang FROM s4")
def _(t: Tables) -> DataFrame:
    pipeline, rows = _pipeline(t)
    return pipeline.run(rows)[0].select("rank", "id", "lang")


@query(
    "url_normalise_dedup",
    r"""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.)?', ''), '[?#].*$', '') AS k FROM pages)
SELECT page_id, k AS url_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS rn FROM k) WHERE rn = 1""",
)
def _(t: Tables) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.|m\.)?", ""), "[?#].*$", "")
    return dedup.keep_first(t.pages.select("page_id", key.alias("url_key")), ["url_key"], ["page_id"])


def _cascade() -> rules.FilterCascade:
    return rules.FilterCascade([("missing date", F.col("l_shipdate").isNull()), ("returned", F.col("l_returnflag") == "R"), ("deep discount", F.col("l_discount") > 0.08), ("tiny", F.col("l_quantity") < 3)])


_REASON = "CASE WHEN l_shipdate IS NULL THEN 'missing date' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'deep discount' WHEN l_quantity < 3 THEN 'tiny' END"


@query("filter_reason_cascade", f"SELECT {_REASON} AS filter_reason, count(*) AS n FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    cascade = _cascade()
    cascade.apply(t.lineitem)
    return cascade.counts()


@query(
    "filter_attrition",
    f"""WITH f AS (SELECT l_orderkey, min(CASE {_REASON} WHEN 'missing date' THEN 0 WHEN 'returned' THEN 1 WHEN 'deep discount' THEN 2 WHEN 'tiny' THEN 3 ELSE 4 END) AS p FROM lineitem GROUP BY 1),
r AS (SELECT * FROM (VALUES (0, 'missing date'), (1, 'returned'), (2, 'deep discount'), (3, 'tiny')) v(p, rule))
SELECT CAST(r.p + 1 AS INT) AS step, rule, (SELECT count(*) FROM f WHERE f.p = r.p) AS lost, (SELECT count(*) FROM f WHERE f.p > r.p) AS "left" FROM r""",
)
def _(t: Tables) -> DataFrame:
    cascade = _cascade()
    cascade.apply(t.lineitem)
    return cascade.attrition("l_orderkey")


@query("filter_kept_rejected", f"SELECT {_REASON} IS NULL AS kept, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    kept, rejected = _cascade().apply(t.lineitem)
    both = kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)), allowMissingColumns=True)
    return both.groupBy("kept").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"))


@query(
    "string_normalisers",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, lower(regexp_replace(url, '[^A-Za-z ]', '', 'g')) AS letters,
  regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS alnum, regexp_extract(url, '^[^:]+') AS scheme FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug("url").alias("slug"), T.letters_key("url").alias("letters"), T.alnum_key("url").alias("alnum"), T.first_item("url", ":").alias("scheme"))


@query(
    "identifier_normalise",
    r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.1/AB' || o_orderkey || '.' WHEN 1 THEN ' doi: 10.1/ab' || o_orderkey WHEN 2 THEN 'na' ELSE 'http://dx.doi.org/10.2/' || o_orderkey || ';' END AS d FROM orders)
SELECT o_orderkey, nullif(nullif(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(d)), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[.,;]+$', '')), ''), 'na'), 'null') AS doi FROM x""",
)
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("https://doi.org/10.1/AB"), key, F.lit("."))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" doi: 10.1/ab"), key)).when(F.col("o_orderkey") % 4 == 2, "na").otherwise(F.concat(F.lit("http://dx.doi.org/10.2/"), key, F.lit(";")))
    return t.orders.select("o_orderkey", T.normalize_doi(raw).alias("doi"))


@query(
    "standardise_values",
    """SELECT p_partkey, CASE WHEN lower(p_name) IN ('ring', 'widget') THEN lower(p_name) || 's' WHEN contains(lower(p_name), 'sprocket') THEN 'sprockets' WHEN contains(lower(p_name), 'widget') THEN 'widgets' WHEN contains(lower(p_name), 'ring') THEN 'rings' ELSE lower(p_name) END AS product FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.standardize("p_name", {"ring": "rings", "widget": "widgets", "sprocket": "sprockets"}).alias("product"))


@query("recode_values", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'property' WHEN 'AUTOMOBILE' THEN 'vehicles' ELSE 'other' END AS sector FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.recode("c_mktsegment", {"BUILDING": "property", "AUTOMOBILE": "vehicles"}, "other").alias("sector"))


@query(
    "nullify_and_default",
    "SELECT doc_id, nullif(lang, 'de') AS lang, coalesce(nullif(lang, 'de'), nullif(trim(source), ''), 'Unknown') AS filled FROM documents",
)
def _(t: Tables) -> DataFrame:
    lang = S.nullify("lang", ["de"])
    return t.documents.select("doc_id", lang.alias("lang"), S.first_present(lang, "source", default="Unknown").alias("filled"))


@query(
    "numeric_scalars",
    """SELECT p_partkey, round(log10(p_size + 1), 6) AS log_size, round(CASE WHEN p_size > 0 THEN 1000.0 * p_retailprice / p_size END, 6) AS density, round(greatest(0.0, least(1.0, p_size / 40.0)), 6) AS clamped,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE WHEN p_size BETWEEN 5 AND 45 THEN p_size END AS plausible FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.round(S.log10p1("p_size"), 6).alias("log_size"), F.round(S.density("p_retailprice", "p_size"), 6).alias("density"), F.round(S.clamp(F.col("p_size") / 40.0), 6).alias("clamped"),
        S.band("p_size", [10, 30], ["small", "medium", "large"]).alias("band"), S.plausible("p_size", 5, 45).alias("plausible"),
    )


@query(
    "multi_value_explode",
    "SELECT w AS word, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    rows = nested.exploded(t.part.select("p_partkey", "p_name"), "word", T.split_multi("p_name", r"\s+"))
    return rows.groupBy("word").agg(F.countDistinct("p_partkey").alias("parts"))


@query(
    "product_expand",
    "SELECT p_partkey, w AS word, x AS piece FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w, p_type FROM part), unnest(list_distinct(string_split(lower(p_type), ' '))) u(x)",
)
def _(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("word"), F.col("p_type").alias("piece"))
    return nested.expand_product(rows, {"word": F.split("word", " "), "piece": F.split(F.lower("piece"), " ")})


@query(
    "swap_recovery",
    """SELECT s_suppkey, 'original' AS variant, s_name AS left_value, CAST(s_nationkey AS VARCHAR) AS right_value FROM supplier
UNION ALL SELECT s_suppkey, 'swapped', CAST(s_nationkey AS VARCHAR), s_name FROM supplier WHERE s_nationkey > 15""",
)
def _(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_name").alias("left_value"), F.col("s_nationkey").cast("string").alias("right_value"), "s_nationkey")
    return nested.recover_swaps(rows, "left_value", "right_value", F.col("s_nationkey") > 15).drop("s_nationkey")


@query(
    "line_assembly",
    """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS record FROM l)
SELECT doc_id, CAST(record AS BIGINT) AS record, CAST(count(*) AS INT) AS lines, CAST(sum(length(line)) + count(*) - 1 AS INT) AS size FROM n GROUP BY doc_id, record""",
)
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = nested.assemble_lines(lines, "doc_id", "pos", "line", F.col("line").rlike("^[A-M]"))
    return out.select("doc_id", "record", "lines", F.length("text").alias("size"))


@query(
    "anchored_repair",
    """WITH w AS (SELECT p_partkey, list_concat(list_concat([CAST(p_size AS VARCHAR) FOR z IN range(0, p_partkey % 3)], ['10.1/' || p_partkey]), list_concat(string_split(p_name, ' '), [p_brand])) AS a, CAST(p_partkey % 3 AS INT) AS k FROM part),
m AS (SELECT p_partkey, a[len(a)] AS last, a[k + 1] AS anchor, a[k + 2:len(a) - 1] AS mid, CASE WHEN k >= 1 THEN a[k] ELSE '' END AS b FROM w)
SELECT p_partkey, b AS before_anchor, anchor, coalesce(mid[1], '') AS first_word, CASE WHEN len(mid) > 1 THEN array_to_string(mid[2:], ', ') ELSE '' END AS rest, last AS brand FROM m""",
)
def _(t: Tables) -> DataFrame:
    lead = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("p_size").cast("string"))
    parts = F.concat(F.slice(lead, F.lit(1), (F.col("p_partkey") % 3).cast("int")), F.array(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))), F.split("p_name", " "), F.array("p_brand"))
    row = nested.repair_row(parts, 5, r"^10\.\d", before=1, after=1)
    fixed = t.part.select("p_partkey", row.alias("r"))
    return fixed.select("p_partkey", *(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(("before_anchor", "anchor", "first_word", "rest", "brand"))))


@query(
    "slots_to_rows",
    """SELECT o_orderkey, CAST(1 AS INT) AS slot, o_orderstatus AS code, CAST(o_custkey AS VARCHAR) AS note FROM orders UNION ALL SELECT o_orderkey, 2, nullif(o_orderpriority, '5-LOW'), CAST(o_custkey AS VARCHAR) FROM orders""",
)
def _(t: Tables) -> DataFrame:
    wide = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("c1"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("c2"), F.col("o_custkey").alias("n"))
    return nested.slots_to_rows(wide, ["o_orderkey"], [{"code": "c1", "note": "n"}, {"code": "c2", "note": "n"}])


@query(
    "flatten_items",
    """WITH o AS (SELECT o_orderkey FROM orders), i AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40)
SELECT o_orderkey, l_linenumber AS line, l_quantity AS quantity FROM o LEFT JOIN i ON l_orderkey = o_orderkey""",
)
def _(t: Tables) -> DataFrame:
    items = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))).alias("items"))
    return nested.flatten_items(t.orders.select("o_orderkey").join(items, "o_orderkey", "left"), ["o_orderkey"], "items", ["line", "quantity"])


@query(
    "merge_objects",
    """WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unclear' ELSE o_orderstatus END AS status, o_orderpriority AS p FROM orders)
SELECT o_custkey, first(status ORDER BY o_orderkey) FILTER (status <> 'unclear') AS status, array_to_string(list_sort(list(DISTINCT p)), ';') AS priorities, count(*) AS chunks FROM c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "unclear").otherwise(F.col("o_orderstatus")).alias("status"), F.array("o_orderpriority").alias("priorities"))
    merged = nested.merge_objects(rows, ["o_custkey"], "o_orderkey", ["status"], ["priorities"])
    return merged.withColumn("priorities", F.array_join("priorities", ";"))


@query(
    "merge_entities",
    """WITH e AS (SELECT l_suppkey, l_partkey, list_sort(list(DISTINCT l_returnflag)) AS flags, count(*) AS chunks, min(CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END) AS g FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, array_to_string(flags, ',') AS flags, chunks, CASE g WHEN 1 THEN 'F' ELSE 'O' END AS support, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY chunks DESC, l_partkey) AS INT) AS listed_rank FROM e""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey", F.array("l_returnflag").alias("flags"), F.col("l_linestatus").alias("support"))
    out = nested.merge_entities(rows, ["l_suppkey", "l_partkey"], F.desc("chunks"), ["flags"], {"support": ["F", "O"]})
    return out.withColumn("flags", F.array_join("flags", ","))


@query(
    "reaggregate_tokens",
    """SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS l_returnflag, CASE WHEN count(*) FILTER (l_quantity > 10) = count(*) THEN 'Resolved' WHEN count(*) FILTER (l_quantity > 10) > 0 THEN 'Partially resolved' ELSE 'Unresolved' END AS status FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return nested.reaggregate(t.lineitem.withColumn("good", F.col("l_quantity") > 10), ["l_orderkey"], "good", "l_discount", ["l_returnflag"]).drop("l_discount")


@query("row_identity", "SELECT doc_id, 'row_' || substr(sha1(doc_id || '||' || source || '||' || lang), 1, 16) AS row_key FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat(F.lit("row_"), F.substr(F.sha1(F.concat_ws("||", F.col("doc_id").cast("string"), "source", "lang")), F.lit(1), F.lit(16))).alias("row_key"))
