"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import stored
from callsift.plans.skew import join_many_to_one


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of each node with an edge; the component is its smallest node.

    Alternates large stars (every node links its larger neighbours to its
    smallest one) and small stars (it links its smaller neighbours and itself to
    the smallest), which ends in one star per component after a number of rounds
    that grows with the logarithm of the longest chain.  Each step of a round is
    a table in the shared folder, so the driver plans few joins at a time;
    smallest neighbours are found with partial aggregation and joined with hot
    nodes split, so a node with very many neighbours is no hot spot.  Nothing but
    a count and a checksum goes to the driver.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = stored(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sized = [F.min("v").alias("m"), F.count("*").alias("n")]
        least = stored(both.groupBy("u").agg(*sized).select("u", F.least("u", "m").alias("m"), "n"), "least")
        raised = join_many_to_one(both.where("v > u"), least, ["u"], rows="n")
        large = stored(raised.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        nearest = stored(large.groupBy("u").agg(*sized), "nearest")
        lowered = join_many_to_one(large, nearest, ["u"], rows="n").where("v <> m")
        moved = lowered.select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(moved.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
