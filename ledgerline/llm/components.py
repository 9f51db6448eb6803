"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

#: Nodes (two longs each, 4 MB in all) whose minima are broadcast; more of them are joined by a shuffle.
FEW_NODES = 1 << 18


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _nearby(nodes: DataFrame, edges: int) -> DataFrame:
    """A table of at most two rows an edge for a join on ``u``: broadcast if that is few, else written.

    The written table is shuffled for the join alone, so a node with very many links is a skewed join that
    AQE splits; an aggregation right before the join would keep it from that.
    """
    return F.broadcast(nodes) if 2 * edges <= FEW_NODES else cut(nodes, "nodes")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node reachable.

    Alternating large-star and small-star steps: each node hooks its larger neighbours, then itself and
    its smaller ones, onto the smallest node next to it.  The edge set stays as small as the input.  Minima
    are aggregated before the shuffle, and joined by broadcast or as a table of one row a node (see
    ``_nearby``), so a node with very many links is no hot spot.  Ends when a round changes nothing;
    self-links and nulls are dropped; repeated links count once; an empty table gives an empty one.
    """
    edge = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut(edges.where("u != v").select(*edge).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state, n = seen, seen[0]
        both = _both(now)
        least = _nearby(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large if 2 * n <= FEW_NODES else cut(large, "links")
        least = _nearby(large.groupBy("u").agg(F.min("v").alias("m")), n)
        hooked = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(hooked.where("u != v").distinct(), "links")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
