"""Connected components by alternating stars; nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; edges are (a, b), nodes without an edge are left out.

    Both steps hang neighbours on the smallest one known: first each node's larger neighbours, then its smaller ones.  A node with very
    many neighbours meets one row of minima only, so that join can be split.  Ends when no edge changes.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.join(lowest, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
