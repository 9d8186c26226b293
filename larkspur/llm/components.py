"""Connected components of a distributed set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star_roots(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """links: columns a and b, of one orderable type. One row (node, root) per linked node but the roots; a root is its component's smallest node.

    A large star moves each larger neighbour of a node to the smallest one, a
    small star does so with the smaller neighbours; the links become stars in
    a number of rounds that grows with the logarithm of the component's size.
    Each round is written, so its size is that of the links. Minima are combined
    before their shuffle and written before they are joined: both sides of the
    joins are then plain exchanges, of which adaptive execution splits the
    partition of a node with many links.
    """
    pairs = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    pairs = scratch.table(pairs, "stars0")
    for k in range(1, most_rounds):
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = scratch.table(both.groupBy(F.col("node").alias("u")).agg(F.min("root").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}")
        # Each link is a larger neighbour (node) of a smaller one (root).
        large = pairs.join(least, pairs["root"] == least["u"]).select("node", F.col("m").alias("root")).distinct()
        large = scratch.table(large, f"large{k}")
        least = scratch.table(large.groupBy(F.col("node").alias("u")).agg(F.min("root").alias("m")), f"parent{k}")
        small = large.join(least, large["node"] == least["u"])
        small = small.select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").unionByName(least.select(F.col("u").alias("node"), F.col("m").alias("root")))
        pairs = scratch.table(small.distinct(), f"stars{k}")
        for name in (f"least{k}", f"large{k}", f"parent{k}", f"stars{k - 1}"):
            scratch.drop(name)
        # Stars: no root is anybody's node, and so each node has one root.
        if pairs.join(pairs.select(F.col("root").alias("node")), "node", "left_semi").isEmpty() and pairs.groupBy("node").count().where("count > 1").isEmpty():
            return pairs
    raise RuntimeError("the components didn't settle")
