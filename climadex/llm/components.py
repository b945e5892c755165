"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of a link; the component is its smallest node.

    Each round groups by node with a combining minimum and joins the minimum back; joins of
    hubs are left to adaptive skew handling.  Rounds grow with the logarithm of the longest
    chain; the links are written to the shared folder after each.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    with scratch(links.sparkSession) as rounds:
        edges = _converged(stored(edges, "links"), most_rounds, rounds)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _converged(edges: DataFrame, most_rounds: int, rounds) -> DataFrame:
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            return edges
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "links")
        rounds.clear(keep=rounds.folders[-1:])  # nothing reads the round before any more
        new = _state(edges)
        if new == state:
            return edges
        state = new
    raise RuntimeError("components have not converged")
