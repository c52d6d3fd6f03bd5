"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the undirected ``links`` (a, b) with its component's smallest node.

    A round gives each node's larger neighbours, then its smaller ones, the smallest
    neighbour it knows of; the number of rounds grows with the logarithm of the longest
    path.  Steps are grouped minima and equi-joins of written tables, whose skewed keys
    Spark can split; no node's links ever meet in one row.  Self links and repeated links
    don't matter; an empty table gives an empty table; null ends are no links.
    """
    oriented = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = staged(oriented.distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = staged(large.distinct())
        low = staged(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(low).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
