"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repurchase.llm.storage import stored


def keyed(node: Column) -> Column:
    """The node as a join key of another type: the join then gets two plain exchanges, and adaptive execution can
    split a hot node, which it does not above an aggregate on the same key."""
    return node.cast("string").alias("key")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> node, root: the smallest node reachable, for every node with an edge.

    Alternates large-star and small-star steps: neighbours are only compared with the minimum of a node, so no list
    of neighbours is ever gathered, and the number of rounds grows with the logarithm of the longest path.
    """
    current = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(keyed(F.col("a")), F.least("a", "m").alias("m"))
        large = current.select("a", keyed(F.col("b"))).join(least, "key").select("a", F.col("m").alias("b"))
        # A node has no more smaller neighbours than it began with, so a key is not hot here.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        current = stored(star.where("a != b").distinct(), "edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
