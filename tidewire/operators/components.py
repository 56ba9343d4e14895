"""Connected components of a graph given as links, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut_lineage


def _lowest(links: DataFrame) -> DataFrame:
    """(u, low): each node of the first column with its lowest neighbour, itself included."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links`` (u, v) that is not the lowest of its component, with that lowest one.

    Two steps alternate until nothing changes. Large: every node ties its
    higher neighbours to its lowest one. Small: every node ties its lower
    neighbours and itself to its lowest one. Both keep the components, and
    together they leave stars around the lowest nodes. Minima are taken on
    the map side, so a node with a great many links costs one row per task.
    """
    edges = cut_lineage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = _lowest(large)
        small = large.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut_lineage(small.unionByName(lows.filter("u <> low").select("u", F.col("low").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
