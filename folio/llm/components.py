"""Connected components of links, all in DataFrames, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, spread_join, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """a, b and m, the least b of each a. The edges of a hub are dealt over many tasks."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    return spread_join(edges, least, ["a"], "k", "b", n).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b: long) to node, component: the smallest node that can be reached. Nodes without links and links with nulls give no row."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = written(large, "stars")
        small = _with_least(large, state[0])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, written(small, "links")
        remove(old)
        remove(large)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
