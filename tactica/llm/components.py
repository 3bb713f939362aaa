"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or smaller) neighbours of each node, and the node, at its smallest neighbour.

    Minima are partial sums; the join back has one row per node on its small
    side, so a node with very many links is split by the skew join.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.where("b > a") if large else both
    out = out.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``edges`` (a, b) reaches, by turns of large
    and small stars (a number of rounds that grows with the logarithm of the nodes). Links of a node
    to itself, nulls and repeated links count for nothing; a node without other links is left out."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    last = edges.agg(*mark).first()
    while True:
        edges = written(_star(_star(edges, True), False), "links")
        now = edges.agg(*mark).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
