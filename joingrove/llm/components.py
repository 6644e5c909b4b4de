"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import join_copies
from joingrove.sources.staging import discard, stage_observed

#: Rounds until a failure is reported; the number needed grows with the logarithm of the longest chain.
MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that can be reached, for every node of a link to another one.

    Nodes are longs. Links may repeat and stand in either direction; null ends and links of a node to
    itself are left out; without links there are no rows. Each round is written and nothing is collected but its row
    count and a sum. Of a node's neighbours only the minimum and the number are grouped, which partial aggregation
    makes small before the shuffle; links of nodes with very many neighbours are dealt over copies of that minimum.
    """
    edges = (links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
             .where("u != v and u is not null and v is not null").distinct())
    edges, state = _written(edges)
    if not state[0]:  # no round has anything to do
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        larger, _ = _written(_large_star(edges, 2 * (state[0] or 0)))
        after, now = _written(_small_star(larger, state[0] or 0))
        for done in (edges, larger):
            discard(done)
        if now == state:
            roots = after.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges, state = after, now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    out, seen = stage_observed(edges, "components", F.count(F.lit(1)).alias("n"),
                               F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    return out, (seen["n"], seen["x"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_copies(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", least.select("u", "n"), total, total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_copies(edges, least.select("u", "m"), "u", least.select("u", "n"), total, total)
    moved = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
