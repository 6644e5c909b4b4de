"""How good a matcher is: precision and recall of all thresholds against known links (A12 with B2 and B3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Places that weights are told apart by, which bounds the number of thresholds.
PLACES = 6


def match_quality(scored: DataFrame, links: DataFrame) -> DataFrame:
    """(threshold, pairs, hits, precision, recall): what is kept with at least that weight, a row per weight that occurs.

    `scored` has pairs (table1, col1, table2, col2, weight), `links` known ones (from_table, to_table, from_col, to_col) in one or
    both directions; direction and repeats do not count. Links that no pair scores count as missed. Pairs are counted
    per weight first; one ordered pass over the counts gives all thresholds.
    """
    swap = F.col("from_table") > F.col("to_table")
    ends = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    known = links.select(ends("from_table", "to_table").alias("table1"), ends("from_col", "to_col").alias("col1"),
                         ends("to_table", "from_table").alias("table2"), ends("to_col", "from_col").alias("col2")).distinct()
    total = known.agg(F.count(F.lit(1)).alias("links"))
    hit = scored.join(known.withColumn("hit", F.lit(1)), ["table1", "col1", "table2", "col2"], "left")
    counts = hit.groupBy(F.round("weight", PLACES).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    down = W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    kept = counts.select("threshold", F.sum("n").over(down).alias("pairs"), F.sum("h").over(down).alias("hits"))
    return (kept.join(F.broadcast(total)).select("threshold", "pairs", "hits", (F.col("hits") / F.col("pairs")).alias("precision"),
                                                 F.try_divide(F.col("hits").cast("double"), "links").alias("recall")))
