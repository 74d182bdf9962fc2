"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch


def connected_components(edges: DataFrame, tmp: Scratch, most_rounds: int = 60, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node that can be reached.

    Large star links each node's larger neighbours to the least of itself and its neighbours; small star links its
    smaller neighbours and itself to the least neighbour. It ends when a round leaves the edges as they were, when they
    are stars around the least nodes. Hot nodes are combined before the shuffle by min(). The least neighbours are sent to
    all tasks while the counted edges are few; beyond that they are written, so that the join with them splits hot nodes.
    """

    def least(pairs: DataFrame, name: str) -> DataFrame:
        x = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return F.broadcast(x) if count <= broadcast_rows else tmp.write(x, name)

    cur = tmp.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    measure = lambda x: tuple(x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    was = measure(cur)
    for k in range(most_rounds):
        count = was[0]
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both.unionByName(both.select("u", F.col("u").alias("v"))), f"cc-l{k}")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = tmp.write(large, f"cc-a{k}")
        # In `large` every edge points from a larger u to a smaller v already.
        linked = large.join(least(large, f"cc-s{k}"), "u")
        star = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        new = tmp.write(star.filter("u <> v").distinct(), f"cc{k + 1}")
        now = measure(new)
        tmp.drop(f"cc-l{k}", f"cc-a{k}", f"cc-s{k}", f"cc{k}")
        cur = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Each u has one v now, the least node, and no v is a u.
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
