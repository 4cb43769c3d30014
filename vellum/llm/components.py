"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and a join of edges to it; a hub's edges may be
split over tasks, no node's neighbours are ever gathered. Each round is cut through the shared folder.

Defined results. An edge with a null end, or from an id to itself: left out. Repeated edges, in either direction: one.
Ids without an edge to another: no row. No rows: no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 50


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> id, component: the smallest id reachable, for every id that has an edge to another."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(own.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
