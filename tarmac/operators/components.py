"""Connected components of link tables by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.storage import forget, measured, stored


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every linked node, ``root`` being the smallest node of its component.

    ``links`` are undirected and may repeat.  Each round stores its links in the shared folder and drops those of the
    round before; rounds end when the links stay as they are, after about the logarithm of the longest path.  Stars are
    kept as pairs, so a large component is never gathered: smallest neighbours come from partial aggregation.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour is linked to the smallest node nearby
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select("u", "v", "m")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        last = edges
        edges, state = measured(small.where("u != v").distinct(), n=F.count(F.lit(1)), s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        forget(last)
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
