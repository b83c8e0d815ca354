"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge.

    Large-star and small-star steps in turn until the edges stay as they are.
    Each step writes its edges to the shared folder, so a lost executor costs
    one step.  A node's neighbours are never gathered: each step takes their
    minimum and joins it back, and Spark splits the join of a hub.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, before = stored(both, "edges"), None
    while True:
        # large star: neighbours above a node move to the least of the node and its neighbours
        near = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(out.where("u > v").distinct(), "edges")
        # small star: neighbours below a node move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        out = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(out.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "edges")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
