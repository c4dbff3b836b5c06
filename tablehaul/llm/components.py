"""Connected groups of a link table by alternating star steps; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    ).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its group, for every node that has a link.

    Rounds are logarithmic in the number of links. Only a count and a sum of hashes reach the driver.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    current, before = stored(edges.filter("a <> b").select("a", "b").distinct(), "links"), None
    while True:
        now = stored(small_star(large_star(current)), "links")
        after = state(now)
        if after == before:
            break
        current, before = now, after
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return pairs.union(roots)
