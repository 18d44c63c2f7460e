"""Distributed union-find over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node that isn't the smallest of its component; root is the smallest.

    Rows with a null end and self-loops are ignored.  The number of rounds follows the logarithm of a
    component's diameter.  Each round is written to the shared folder, so it is never computed twice, and
    only a count and a checksum reach the driver.  A hub's edges are split by adaptive skew joins.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    pairs = pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    star, seen = materialize(pairs, "cc"), None
    while True:
        state = star.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (state.n, state.x)
        # the smallest neighbour of each edge's lower end, itself included
        ends = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ends.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(star.join(lowest, "v").select("u", F.col("m").alias("v")).distinct(), "cc-large")
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.unionAll(parent.select("u", F.col("m").alias("v"))).distinct(), "cc")
        for old in (star, large):
            discard(old)
        star = after
