"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the component is its smallest node; nodes without edges don't appear.

    Each round hooks every label to the smallest label next to it and then jumps to that label's own
    label, so the rounds grow with the logarithm of the longest path. Rounds are written tables: no
    lineage builds up and lost executors cost one round at most. Null ends and loops are ignored.
    """
    both = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    table = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        labels = table.select("node", "component")
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        # A component's own label takes the smallest label that any of its members sees.
        seen = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        hook = seen.groupBy("component").agg(F.min("m").alias("h"))
        moved = seen.join(hook, "component").select("node", F.col("component").alias("was"), F.least("m", "h").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("j"))
        moved = materialize(moved.join(jump, "c", "left").select("node", "was", F.least("c", F.coalesce("j", "c")).alias("component")))
        release(table)
        table = moved
        if table.filter("was <> component").isEmpty():
            release(both)
            return table.select("node", "component")
