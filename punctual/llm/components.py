"""Connected components by hooking to the smallest neighbour and contracting; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, root)``, root the smallest node reachable; isolated nodes are not listed.

    In a round every node goes to its smallest neighbour, chains are followed to their ends by doubling, and only
    edges between different ends are left for the next round. At least every second node of those with edges goes,
    and a group around one node is done in one round, so what a join reads falls from round to round. Each join is
    between written tables, so Spark can split a node with very many neighbours; minima are combined before they
    are shuffled. Null ends are ignored.
    """
    left, labels = store(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    while labels is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        up = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "up")
        while True:
            ends = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            longer = store(up.join(ends, "root").select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "up")
            up = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            tops = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = store(labels.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        of = lambda end, name: up.select(F.col("node").alias(end), F.col("root").alias(name))
        met = left.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        left = store(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
