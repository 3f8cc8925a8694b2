"""Connected components by alternating large and small stars.

Every step is a grouped minimum, which is combined before its shuffle, and an
equi-join that Spark can split where a node is hot.  Each round is written to
the shared folder, which cuts the lineage.  Nothing but two sums per round goes
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.common import Shared


def connected_components(edges: DataFrame, shared: Shared, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that has a link to another; root is the smallest node reached."""
    now = shared.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(rounds):
        # Large star: all larger neighbours of a node move to the least of its neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself move to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        after = shared.put(small.distinct())
        shared.drop(now)
        now = after
        # Folded to 40 bits so that the sum cannot overflow.
        found = now.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24))).first()
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
