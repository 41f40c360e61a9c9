"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.checkpoints import cut


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges reach, itself included) for each of ``nodes`` (node).

    ``edges`` has a and b.  Every round links each node's larger neighbours
    (large star), then its smaller ones (small star), to the least of them;
    the number of rounds grows with the logarithm of a component's size.  A
    node with very many edges is reduced by map-side minima, never gathered.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        before, state = state, tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
    found = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select("node").join(found, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
