"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node of a link.

    Each step connects the neighbours of a node to the least of them, first the larger
    ones, then the smaller ones; it ends when the links are stars.  The number of steps
    grows with the logarithm of the longest chain.  Each step is written to the shared
    folder, so lineage stays short and a lost executor costs one step.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "stars")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = stored(small.where("u != v").distinct(), "stars")
        new = _state(after)
        discard(spark, edges)
        edges, done, state = after, new == state, new
        if done:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.union(ends.select(F.col("label").alias("node"), "label").distinct())
