"""Text regions and nested data: snippets, sections, chunks, pages, claims, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import extract
from ledgerline.plans.base import Tables, query


@query("chunks", "SELECT doc_id, CAST(k AS INT) AS chunk_no, length(substr(text, k * 400 + 1, 500)) AS size, md5(substr(text, k * 400 + 1, 500)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) // 400 + 1)) AS k FROM documents WHERE text <> '')")
def _(t: Tables) -> DataFrame:
    out = extract.chunks(t.documents, "doc_id", "text", 500, 100)
    return out.select("doc_id", "chunk_no", F.length("chunk").cast("long").alias("size"), F.md5("chunk").alias("digest"))


@query(
    "sections",
    """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT *, regexp_matches(line, '^[A-E]') AS h FROM l),
n AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM h),
b AS (SELECT doc_id, CAST(s AS INT) AS section_no, coalesce(trim(first(line ORDER BY pos) FILTER (h)), 'preamble') AS heading, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '')) AS body FROM n GROUP BY ALL)
SELECT doc_id, section_no, md5(heading) AS heading, length(body) AS size FROM b WHERE body <> ''""",
)
def _(t: Tables) -> DataFrame:
    out = extract.sections(t.documents, "doc_id", "text", "^[A-E]")
    return out.select("doc_id", "section_no", F.md5("heading").alias("heading"), F.length("body").cast("long").alias("size"))


@query(
    "keyword_snippets",
    """WITH g AS (SELECT doc_id, text, string_split_regex(text, 'thing|tion') AS g, regexp_extract_all(text, 'thing|tion') AS m FROM documents),
p AS (SELECT doc_id, length(text) AS n, unnest(g[1:len(m)]) AS g, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS i FROM g),
h AS (SELECT doc_id, n, i, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(m) AS w FROM p),
s AS (SELECT doc_id, greatest(e - w - 40, 0) AS s, least(e + 40, n) AS e, i FROM h),
k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
x AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM k),
y AS (SELECT doc_id, place, min(s) AS s, max(e) AS e FROM x GROUP BY ALL HAVING place <= 5),
z AS (SELECT *, 300 - coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM y)
SELECT doc_id, CAST(place AS INT) AS place, CAST(s AS INT) AS start, CAST(least(e, s + budget) AS INT) AS "end", md5(substr(text, CAST(s AS BIGINT) + 1, CAST(least(e - s, budget) AS BIGINT))) AS digest FROM z JOIN documents USING (doc_id) WHERE budget > 0""",
)
def _(t: Tables) -> DataFrame:
    return extract.snippets(t.documents, "doc_id", "text", "thing|tion", window=40, most=5, budget=300).withColumn("digest", F.md5("snippet")).drop("snippet")


@query("evidence_windows")
def _(t: Tables) -> DataFrame:
    return extract.evidence(t.documents, "doc_id", "text", "thing").select("doc_id", "place", F.length("sentence").alias("size"), F.md5("sentence").alias("digest"))


@query("paragraph_triage", "WITH p AS (SELECT doc_id, unnest(range(0, len(s))) AS place, unnest(s) AS p FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS s FROM documents)), k AS (SELECT doc_id, place, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY place) AS used FROM p WHERE regexp_matches(lower(p), 'ing')) SELECT doc_id, CAST(place AS INT) AS place, CAST(used AS BIGINT) AS used FROM k WHERE used <= 2000")
def _(t: Tables) -> DataFrame:
    return extract.triage(t.documents, "doc_id", "text", "ing", 2000).select("doc_id", "place", "used")


@query("html_text_meta", """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, len(regexp_extract_all(html, '<a ')) AS links FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))


@query("html_visible_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(T.html_text("html")).alias("digest"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.salvage_json("props", "k long")["k"].alias("k"))


@query("guess_language", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(substr(text, 1, 6000)), '[^\pL]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'is'))) / len(w) AS en, len(list_filter(w, lambda x: x IN ('le', 'la', 'de', 'et'))) / len(w) AS fr FROM w)
SELECT doc_id, CASE WHEN n < 30 THEN 'unclear' WHEN fr >= en AND fr > 0.12 THEN 'fr' WHEN en > fr AND en > 0.12 THEN 'en' ELSE 'other' END AS language FROM s""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.guess_language("text", {"en": ("the", "of", "and", "is"), "fr": ("le", "la", "de", "et")}).alias("language"))


@query("character_shares", "SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0), 6) AS digits FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(T.share_of("text"), 6).alias("digits"))


@query("sentence_counts")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.sentences("text")).alias("sentences"))


@query("candidate_names")
def _(t: Tables) -> DataFrame:
    names = t.documents.select(F.explode(T.candidate_names("text")).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query("quote_support")
def _(t: Tables) -> DataFrame:
    """Sixty characters from the middle of each text, two letters swapped in some, as quotes of it: as they are, misspelt, too short to be misspelt, or of no text."""
    middle = F.substr("text", (F.length("text") / 2).cast("int") + 1, F.when(F.col("lang") == "es", 20).otherwise(60))
    swapped = F.regexp_replace(F.regexp_replace(middle, "^(.{3})(.)(.)", "$1$3$2"), "(.)(.)(.{3})$", "$2$1$3")
    quote = F.when(F.col("lang") == "en", middle).when(F.col("lang") == "fr", F.concat(F.lit("no such words in this text: "), F.reverse(middle))).otherwise(swapped)
    return t.documents.select("doc_id", T.quote_support(quote, "text").alias("support"))


@query(
    "claim_detection",
    """WITH s AS (SELECT doc_id AS key, list_transform(list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), '. '), lambda x: contains(lower(x), 'thing')), lambda x: trim(x)) AS f FROM documents),
h AS (SELECT key, f, len(f) AS n, len(list_filter(f, lambda x: contains(lower(x), 'is') OR contains(lower(x), 'of'))) AS h FROM s)
SELECT key, n > 0 AS is_claim, CAST(n AS INT) AS found, CAST(h AS INT) AS hedged, round(CASE WHEN n > 0 THEN 1 - h / (2.0 * n) ELSE 0 END, 6) AS confidence, md5(array_to_string(f[1:3], '|')) AS evidence FROM h""",
)
def _(t: Tables) -> DataFrame:
    out = extract.keyword_claims(t.documents, "doc_id", "text", ["thing"], ["is", "of"])
    # As SQL rounds: the scaled number, not its decimals.
    return out.withColumn("confidence", F.round(F.col("confidence") * 1e6) / 1e6).withColumn("evidence", F.md5(F.array_join("evidence", "|")))
