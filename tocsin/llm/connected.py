"""Connected components of an edge table by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import Scratch


#: A node with more than this share of all edges (and more than the least number) is met by a broadcast, the others by a
#: shuffle. So at most 2,000 nodes are sent, and a task of the shuffle holds no node with many edges.
HUB_SHARE, HUB_LEAST = 1_000, 64


def _with_least(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The edges with the smallest neighbour v of their node u as m, and one row (u, m) per node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    tagged = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    of_hubs = tagged.where(F.col("hub").isNotNull()).select("u", "v", F.col("hub_m").alias("m"))
    others = tagged.where(F.col("hub").isNull()).select("u", "v")
    small = least.where(F.col("n") <= limit).select("u", "m")
    return of_hubs.unionByName(others.join(small, "u").select("u", "v", "m")), least.select("u", "m")


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = _with_least(both, limit)[0].withColumn("m", F.least("u", "m"))
    return known.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    known, least = _with_least(edges, limit)
    out = known.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long). Returns node, component (its smallest node) for every node but the smallest ones.

    The result is read from scratch tables and ends with them.

    Rounds end when the edge table no longer changes. Every star is written, so lineage stays short and the driver plans
    one star at a time: a star reads its edges several times, and a plan of both would hold the first that often. A star
    adds an edge for each node at most, so one limit for hubs serves both stars of a round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = scratch.written(now, "edges"), None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == seen or not row[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(row)
        limit = max(HUB_LEAST, row[0] // HUB_SHARE)
        tied = scratch.written(_large_star(now, limit), "stars")
        now = scratch.written(_small_star(tied, limit), "edges")
