"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(src long, dst long)``; root is the component's smallest node.

    Each round is two joins on pre-aggregated minima; rounds grow with the logarithm of the
    longest path. Self loops and repeated edges are allowed; no edges give no rows.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = pairs.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        met = pairs.join(least, "src")
        if large:
            return met.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        rest = met.filter(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        return rest.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()

    ends = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    pairs = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()
    pairs = checkpointed(pairs)
    before = ends(pairs)
    while before["n"]:
        pairs = checkpointed(star(star(pairs, True), False))
        after = ends(pairs)
        if after == before:
            break
        before = after
    nodes = pairs.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return nodes.unionByName(pairs.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
