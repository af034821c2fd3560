"""Connected components by alternating large-star and small-star steps; no row of it is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, stored


def connected_components(links: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links, component the smallest node reachable.

    Links join nodes that are longs; loops and repeated links do no harm. Each round rewires every node to the smallest
    of its neighbours, first on the larger side and then on the smaller one, which ends in stars after a number of
    rounds in the logarithm of the nodes (Kiveris et al. 2014). Each round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node go to the smallest neighbour or the node itself
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours at or below a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, "links")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        drop_stored(edges)
        edges = new
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
