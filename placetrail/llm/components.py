"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of links(u, v): the smallest node reachable.

    A node's least neighbour is a partial aggregate, so a hub with a large share of all links is reduced before the
    shuffle. Every round is written to the shared folder, and the one before goes; rounds end when the set of links no longer changes.
    """
    now = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    now = cut(now)
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == mark or not seen[0]:
            break
        former, mark, now = now, seen, cut(_stars(now))
        discard(former)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
