"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storing import settled


def _stars(both: DataFrame, larger: bool) -> DataFrame:
    """Link each neighbour (the larger ones, or all that are not larger) to the smallest of node and neighbours.

    The smallest neighbour comes from an aggregation with map-side combine and is joined back, so
    a node with very many neighbours is no group in one task.
    """
    if larger:
        smallest = both.groupBy("a").agg(F.min("b").alias("__m"))
        joined = both.filter("b > a").join(smallest, "a")
        return joined.select(F.col("b").alias("a"), F.least("a", "__m").alias("b"))
    down = both.filter("b < a")
    smallest = down.groupBy("a").agg(F.min("b").alias("__m"))
    joined = down.join(smallest, "a")
    return (joined.select(F.col("b").alias("a"), F.col("__m").alias("b"))
            .unionByName(smallest.select("a", F.col("__m").alias("b"))).filter("a <> b"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node of its component.

    Large-star and small-star steps in turn, each round written to the shared folder, until the
    links no longer change; the number of rounds grows with the logarithm of the longest chain.
    """
    links = links.filter("a <> b")
    before = None
    for _ in range(most_rounds):
        large = _stars(_both_ways(links), larger=True).distinct()
        links = settled(_stars(large, larger=False).distinct(), "stars")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
