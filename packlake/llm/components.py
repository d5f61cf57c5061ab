"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `links` (a, b); the component is its smallest node.

    Each round links the neighbours of a node to the smallest of them, first the larger, then the
    smaller ones. Neighbours are never brought together: a round joins the links with a minimum for each
    node. Links of a node with itself are left out. No links give no rows.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = staged(links.where("a <> b").select(high, low).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = staged(small.union(least.select("a", "m")).distinct(), "links")
