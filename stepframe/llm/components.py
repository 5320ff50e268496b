"""Connected components of an edge table, as joins and aggregates with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.sizing import cut_lineage



def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node that it can reach; nodes are longs.

    Alternates two contractions until nothing changes: every larger neighbour of a node is linked to the node's
    smallest neighbour, then every smaller one. A round shuffles the edges that are left, never more than there were;
    a hot node's rows are pre-aggregated for its minimum and split by Spark's skew join when the minimum comes back.
    Null ends and loops are left out. An empty table gives an empty one.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    current = cut_lineage(ends.where("u <> v").distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    stars = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
