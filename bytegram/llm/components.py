"""Connected components of a table of links, by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegram.llm.common import dropped, sorted_join, written


def _lowest(edges: DataFrame) -> DataFrame:
    """``a, b, low``: each row of ``edges`` with the smallest ``b`` of its ``a`` (summed up before the shuffle)."""
    return edges.join(sorted_join(edges.groupBy("a").agg(F.min("b").alias("low"))), "a")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links (a, b)``; nodes are longs.

    Every round writes its links to the shared folder. The rounds end when a round changes nothing; their number
    grows with the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_lowest(both).filter("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())
        large = written(large, "links")
        small = _lowest(large)
        stars = (small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct())
        stars = written(stars, "links")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(edges, large)
        edges = stars
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
