"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds grow with the logarithm of the longest chain; this many cover any table.
MAX_ROUNDS = 60


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of each node of undirected edges (u, v): (node, component), the smallest node reachable.

    Each round points larger neighbours of every node at its smallest neighbour, then
    smaller ones too, until edges stand still as stars. A round takes minima by
    node and joins them to the edges: a node with very many neighbours is
    aggregated before the shuffle, and its edges may be split over tasks. Each
    round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        both = _neighbours(edges)
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select("u", "v", "m")
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v != m").distinct()
        edges = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
