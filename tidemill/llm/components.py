"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _summary(edges: DataFrame) -> tuple:
    """The number of edges and the sum of their hashes, the same for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (columns a, b): the smallest node that it reaches.

    Large-star and small-star rounds alternate until nothing changes: the
    number of rounds grows as the logarithm of the longest path.  Nulls and
    links of a node with itself are left out.  Minima are combined before each
    shuffle, and the joins by node may be split where a node has many links.
    """
    # pairs (u, v) with v < u
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _summary(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: all smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "links")
        discard(edges)
        edges, before, seen = after, seen, _summary(after)
        if seen == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti"))
