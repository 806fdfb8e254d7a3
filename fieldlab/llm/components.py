"""Connected components by alternating large-star and small-star rounds, all in DataFrames.

Each round rewires every node to the least node it knows, first among larger neighbours,
then among smaller ones, until nothing changes; the count of rounds is logarithmic in
practice.  A node's least neighbour comes from a partially aggregated ``min``; the rewiring
is an equi-join that adaptive execution may split, so a hub never sits in one task.  Every
round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the least node reachable.

    Null ends and loops are dropped; repeated edges and both directions count once; no
    edges give no rows.  Any orderable type of node will do.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour v of u goes to the least of u's surroundings
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        old, now = now, materialize(small.where("u <> v").distinct(), "edges")
        discard(old)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
