"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, files: int | None = None) -> DataFrame:
    """node, component: the smallest node reachable over undirected edges, for every node that has an edge.

    Large-star and small-star in turn: each node hangs its larger neighbours, then all of them, under the smallest one, until
    nothing changes; rounds grow with the logarithm of the longest path. A node's edges shrink to a star, so that no
    hub gathers its neighbours in one row; minima are pre-aggregated. files: of a round's edges, see `saved`.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = saved(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", files)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, saved(small, "edges", files)
        same = now.join(before, ["u", "v"], "left_anti").limit(1).count() == 0 and before.join(now, ["u", "v"], "left_anti").limit(1).count() == 0
        discard(before)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
