"""Connected components of an edge list by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: of one orderable type) as node, root: the least node of its component.

    Each round hangs every node under the least root that it or a neighbour has, and then halves
    the paths to the roots; rounds grow with the logarithm of the longest path. Every round is a
    table in the shared folder, so a lost executor costs one round at most. Minima are taken
    before the shuffle, so a node with very many edges stays spread out.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        # The least root beside each node, offered to the node and to the node's own root.
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        offers = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("new"))
        offered = offers.select("node", "new").unionByName(offers.filter("new < root").select(F.col("root").alias("node"), "new")).groupBy("node").agg(F.min("new").alias("new"))
        above = offered.select(F.col("node").alias("new"), F.col("new").alias("top"))
        jumped = offered.join(above, "new", "left").select("node", F.least("new", F.coalesce("top", "new")).alias("root"))
        after = stored(jumped)
        changed = after.join(roots.withColumnRenamed("root", "was"), "node").filter("root <> was").limit(1).count()
        roots = after
        if not changed:
            return roots
