"""Connected components of a table of links, by alternating star steps; every step is a shuffle, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwear.runtime import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties every smaller neighbour of a node, and the node, to the smallest of them. ``v`` is below ``u`` in each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """``node, component`` for every node of a link to another node; the component is its smallest node.

    Links may repeat, point to themselves or be null on a side; the latter two are left out. Edges end as stars around the
    smallest node, after a number of rounds that grows with the logarithm of the longest path; ``rounds`` only stops
    a run that would not end.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    edges = settle(edges.distinct(), "edges")
    state = None
    for _ in range(rounds):
        edges = settle(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
