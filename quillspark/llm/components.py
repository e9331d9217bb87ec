"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), two long columns; component is the least node reachable.

    Each round replaces a node's links by links to the least neighbour, so the rounds grow with the logarithm of the
    longest path. Only a count and two checksums come to the driver. The minima are written before they are joined
    back: AQE can then split a node with very many links. Null or equal ends link nothing.
    """
    edges = table(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        roots = table(large.groupBy("a").agg(F.min("b").alias("m")), "roots")
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = table(small.union(roots).distinct(), "links")
        for old in (edges, least, large, roots):
            drop_table(old)
        edges, before, state = after, state, _state(after)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
