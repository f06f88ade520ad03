"""Connected components of a link table by alternating stars, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def _fold(links: DataFrame) -> DataFrame:
    """Distinct links from the larger end to the smaller."""
    return links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; links go from the larger end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of all nodes in links a, b; roots themselves are left out.

    Null ends link nothing. Links may repeat and come in either direction.
    """
    now = materialize(_fold(links.select("a", "b")), "links")
    before = None
    while True:
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_of == before or not print_of[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = print_of
        old, now = now, materialize(_fold(_small_star(_fold(_large_star(now)))), "links")
        discard(old)
