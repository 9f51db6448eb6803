"""URL filters: rules first, and for all other urls a verdict per host from link-graph propagation.

Trust is a personalised PageRank that starts at the hosts where the rules allow pages and follows the
links; distrust starts at the hosts where they block pages and follows the links backwards (who links
to a blocked host is suspect).  Both run over host edges: links between two hosts are one weighted
edge, so a hot host is aggregated before any shuffle of ranks.  A host is blocked where its distrust,
in parts of one seed page, reaches ``least`` and exceeds its trust: pages elsewhere in the table do not
change that.  Trust and distrust are reported as shares of all seed pages.

Ranks are integers (parts of UNIT) and follow an edge by its exact share, rounded down, so sums do not
depend on the order of rows: reruns agree, and SQL can say the same.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; a null
page text has no links; links without a host (relative ones) are none, links that begin with ``//`` are; a
host without links or seeds has trust and distrust 0 and is allowed; where trust equals distrust the host
is allowed; repeated rows count as pages each, and each gets the verdict; an empty table gives an empty
result; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Parts of a rank of 1.
UNIT = 10**12
#: Percent of a rank that follows links; rounds; rounds between written tables; least distrust that blocks.
FOLLOW, ROUNDS, WRITE, LEAST = 85, 12, 4, UNIT // 10**6
#: Links with a host; one that begins with ``//`` has its page's scheme.
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    chain = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another host."""
    src, _ = parts(F.col("url"))
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(src.alias("src"), link.alias("link"))
    dst, _ = parts(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit(":"), "link")).otherwise(F.col("link")))
    return links.select("src", dst.alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _divided(x: str, by: str) -> str:
    """``x div by`` for whole decimals, which ``div`` would cut to 64 bits."""
    return f"cast(({x} - {x} % {by}) / {by} as decimal(38, 0))"


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Ranks (kind, host, rank, weight) of personalised PageRank; edges (kind, src, dst, n), seeds (kind, host, n).

    ``rank`` is in parts of the kind's seeds, ``weight`` in parts of one seed page.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", "n", "all"), "url-edges")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    pages = "cast(n as decimal(38, 0))"
    start = cut(seeds.join(F.broadcast(total), "kind").select("kind", "host", F.expr(f"cast({pages} * {UNIT} div all as long)").alias("rank"), F.expr(f"cast({pages} * {UNIT} as decimal(38, 0))").alias("weight")), "url-seeds")
    ranks = start
    for i in range(1, rounds + 1):
        r = ranks.withColumnRenamed("host", "src")
        follow = [F.expr("cast(rank as decimal(38, 0)) * n div all").alias("rank"), F.expr(_divided("(weight * n)", "all")).alias("weight")]
        moved = shares.join(r, ["kind", "src"]).select("kind", F.col("dst").alias("host"), *follow, F.lit(FOLLOW).alias("percent"))
        kept = start.select("kind", "host", "rank", "weight", F.lit(100 - FOLLOW).alias("percent"))
        sums = moved.unionByName(kept).groupBy("kind", "host").agg(F.expr("sum(rank * percent) div 100").alias("rank"), F.expr("sum(weight * percent)").alias("weight"))
        ranks = sums.withColumn("weight", F.expr(_divided("weight", "100")))
        if i % WRITE == 0 or i == rounds:
            ranks = cut(ranks, "url-ranks")
    return ranks


def judge(pages: DataFrame, rules: tuple = RULES, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    seeds = urls.where("found is not null and host != ''").groupBy(F.when(F.col("found.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    links = host_edges(pages)
    forth = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    edges = cut(forth.unionByName(back), "url-links")
    ranks = propagate(edges, seeds, rounds)
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    blocks = (of("distrust", "weight") >= least) & (of("distrust", "weight") > of("trust", "weight"))
    hosts = ranks.groupBy("host").agg(of("trust", "rank").alias("trust"), of("distrust", "rank").alias("distrust"), blocks.alias("blocks"))
    rows = urls.join(hosts, "host", "left").fillna(0, ["trust", "distrust"])
    by_host = F.when(F.col("blocks"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), by_host).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if what == 'rule' else v}'" for v, h, p in order) + " END"
    split = lambda rest: f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    rest = lambda url: f"CASE WHEN position('://' IN coalesce({url}, '')) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    steps = []
    for i in range(1, ROUNDS + 1):
        steps.append(
            f"""r{i} AS MATERIALIZED (SELECT kind, host, CAST(sum(rank * percent) // 100 AS HUGEINT) AS rank, CAST(sum(weight * percent) // 100 AS HUGEINT) AS weight FROM (
  SELECT s.kind, dst AS host, rank * n // a AS rank, weight * n // a AS weight, {FOLLOW} AS percent FROM shares s JOIN r{i - 1} r ON r.kind = s.kind AND r.host = s.src
  UNION ALL SELECT kind, host, rank, weight, {100 - FOLLOW} FROM r0) GROUP BY kind, host)"""
        )
    link = LINK.removeprefix("(?i)").replace("'", "''")
    return f"""WITH rest AS (SELECT page_id, html, {rest("url")} AS rest FROM pages),
urls AS MATERIALIZED (SELECT page_id, html, {split("rest")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS MATERIALIZED (SELECT *, {case("rule")} AS rule, {case("verdict")} AS found FROM urls),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1, 'i')) AS link FROM urls),
ends AS (SELECT src, {split(rest("CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END"))} AS dst FROM links),
edges AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, CAST(n AS HUGEINT) AS n, CAST(sum(n) OVER (PARTITION BY kind, src) AS HUGEINT) AS a FROM both_ways),
seeds AS (SELECT CASE found WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE found IS NOT NULL AND host <> '' GROUP BY ALL),
r0 AS MATERIALIZED (SELECT kind, host, CAST(CAST(n AS HUGEINT) * {UNIT} // sum(n) OVER (PARTITION BY kind) AS HUGEINT) AS rank, CAST(n AS HUGEINT) * {UNIT} AS weight FROM seeds),
{", ".join(steps)},
hosts AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust,
  coalesce(sum(weight) FILTER (kind = 'trust'), 0) AS good, coalesce(sum(weight) FILTER (kind = 'distrust'), 0) AS bad FROM r{ROUNDS} GROUP BY host)
SELECT page_id, u.host, path, rule, coalesce(found, CASE WHEN bad >= {LEAST} AND bad > good THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM ruled u LEFT JOIN hosts h ON h.host = u.host"""


ORACLE = _oracle()
