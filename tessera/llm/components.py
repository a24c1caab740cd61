"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b: long, no nulls); the component is its smallest node.

    Each round every node takes the smallest label among its neighbours' and
    then that label's own label, so labels run along paths in about the
    logarithm of their length. Labels are written to the shared folder in each
    round. Self-links and repeated links do no harm.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both, "cc-edges")
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "cc-labels")
    while True:
        seen = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        near = label.join(seen, "a").select("a", "l", F.least("l", "m").alias("m"))
        far = label.select(F.col("a").alias("m"), F.col("l").alias("up"))
        new = near.join(far, "m").select("a", F.least("m", "up").alias("l"), (F.least("m", "up") != F.col("l")).alias("moved"))
        new = cut(new, "cc-labels")
        moved = new.filter("moved").limit(1).count()
        label = new.select("a", "l")
        if not moved:
            return label.select(F.col("a").alias("node"), F.col("l").alias("component"))
