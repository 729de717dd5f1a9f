"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task needs the links of a node or a component
together; a round is written to the shared folder and the next starts from there.  The number
of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.  links: (a, b)."""
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = stage_table(edges, "links"), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark == seen or not mark.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = stage_table(small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "links")


class Forest:
    """Union-find over the links that one task sees; the smallest member is the root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
