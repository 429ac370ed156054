"""Connected components by contraction: every round each node joins its smallest neighbour.

A round leaves at most half of the nodes that still have edges, so there are log2(n) rounds at most,
each a few joins over what is left. Nothing but counts comes to the driver. The joins meet a large
component's root only on a side that Spark may split, since the other side is a written table with
one row for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import written


def _flat(hooks: DataFrame) -> DataFrame:
    """Follow (node, root) pointers to their ends by pointer doubling."""
    while True:
        nxt = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
        hooks = written(
            hooks.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "hooks"
        )
        moved = hooks.filter("moved").limit(1).count()
        hooks = hooks.select("node", "root")
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of the component."""
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).filter("root < node")
        hooks = _flat(written(hooks, "hooks"))
        to = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = written(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            to = hooks.select(F.col("node").alias(end), F.col("root").alias("up"))
            edges = edges.join(to, end, "left").select(F.coalesce("up", end).alias(end), other)
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(edges, "edges")
    return labels
