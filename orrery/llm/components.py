"""Connected components by alternating stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import keep


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its own root.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller
    ones; alternating, every component becomes a star round its smallest node within a number
    of rounds logarithmic in its diameter. Each round aggregates with a map-side minimum, so a
    node with very many neighbours costs no task more than its share, and is written down, so
    lineage stays one round long.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = _signature(edges)
    while seen[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        edges = keep(small, "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
