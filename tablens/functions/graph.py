"""Connected components as DataFrame rounds (alternating large-star / small-star)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, few_tasks


def connected_components(edges: DataFrame, src: str, dst: str, node: str = "node",
                         component: str = "component") -> DataFrame:
    """One row (``node``, ``component``) per node that has an edge; the component is its
    smallest node. ``edges`` may repeat rows, hold self loops, nulls (ignored) and either
    direction; nodes can be of any orderable type.

    Every round links each node's larger neighbours to its smallest one (large-star), then
    each node's smaller neighbours to the smallest (small-star); the edges turn into stars in
    O(log^2 n) rounds, so long chains end. The loop runs until all edges are stars, has no round limit,
    and never gathers edges on the driver. A hub's edges are reduced by partial minima, and
    its join is a plain equi join, which AQE splits. Each round is checkpointed reliably.
    """
    e = (edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    loops = e.where("u = v").select("u").distinct()
    e = durable(e.where("u > v").distinct())
    while True:
        n = e.count()
        e = few_tasks(e, n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(few_tasks(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), n))
        # stars: who has a smaller neighbour has no other
        if low.where("m < u and n > 1").isEmpty():
            break
        large = (both.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = few_tasks(few_tasks(large, n).distinct(), n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = durable(few_tasks(small, n).distinct())
    members = e.select(F.col("u").alias(node), F.col("v").alias(component))
    roots = e.select(F.col("v").alias(node)).unionByName(loops.select(F.col("u").alias(node))).distinct()
    roots = roots.join(members.select(node), node, "left_anti")
    return members.unionByName(roots.select(node, F.col(node).alias(component)))
