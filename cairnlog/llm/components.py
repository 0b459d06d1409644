"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.llm import common


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b).

    Each round takes minima per node (combined before the shuffle) and joins them back; a node with very many links
    is a skewed join, which AQE splits. Every round is written to the shared folder, so none is computed twice, and the one
    before is deleted.
    Rounds grow with the logarithm of the longest path. Null ends, loops and repeated links are allowed.
    """
    rows = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = rows.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = common.join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.materialize(large.distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.join(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = common.materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        step = common.join(new, edges.withColumn("old", F.lit(1)), ["u", "v"], "full").agg(
            F.count(F.when(F.col("old").isNull(), 1)).alias("added"), F.count("*").alias("n"), F.count("old").alias("olds")
        )
        row = step.first()
        common.discard(large, edges)
        edges = new
        if row.added == 0 and row.n == row.olds:
            tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            out = common.materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops), "components")
            common.discard(edges)
            return out
    raise RuntimeError("components did not settle")
