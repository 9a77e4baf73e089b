"""Connected components of a DataFrame of edges, without bringing them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import dropped, joined_by_hubs, stored

def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node of its component.

    Alternating large-star and small-star rounds; each is two aggregations with map-side minima and a join of which
    the hubs are done apart. Every round is written to the shared folder.
    """
    now = stored(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, count = None, now.count()
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select("a", F.least("m", "a").alias("m"), "d")
        large = joined_by_hubs(both, low, ["a"], "d", 2 * count).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d"))
        small = joined_by_hubs(large, low, ["a"], "d", 2 * count).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        small = stored(small, "small")
        got = small.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        dropped(large)
        dropped(now)
        now = small
        if tuple(got) == state:
            break
        state, count = tuple(got), got[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
