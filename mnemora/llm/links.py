"""Connected components of a table of links, in rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import durable


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (a, b: long); the root is the smallest node.

    Alternates two steps until nothing changes: every larger neighbour of a node is tied to the
    smallest neighbour, then every smaller one. The number of rounds grows with the logarithm of
    the longest chain. Each round is stored, so a lost executor costs one round at most. The
    neighbours of a node are never gathered: minima are combined before the shuffle, and a node
    with very many neighbours only makes a skewed join, which adaptive execution splits.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = durable(_tied(both).where("a > b").distinct())
        smaller = _tied(edges, keep_own=True)
        edges = durable(smaller.where("a > b").distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _tied(edges: DataFrame, keep_own: bool = False) -> DataFrame:
    """Neighbours of each node tied to its smallest neighbour (or itself)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = edges.join(least, "a")
    if keep_own:  # edges point down: tie a itself and its other neighbours to the minimum
        return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _state(edges: DataFrame) -> tuple:
    """Tells whether two sets of links are the same."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)
