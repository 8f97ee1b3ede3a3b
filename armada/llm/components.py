"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import stash


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are a star around each root; every step
    is a join and a partial minimum, and its result is written to the shared folder.  Minima are written before they are
    joined, so both sides of a join are plain shuffles whose hot nodes Spark can split.  Self-loops and repeated edges are
    harmless; null ends are dropped; no edges give no rows.
    """
    now, last = stash(edges.select("a", "b").where("a != b").distinct(), "edges"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stash(both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # large-star leaves every edge pointing to a smaller node; small-star links those smaller nodes to the smallest
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        now = stash(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
