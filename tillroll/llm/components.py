"""Connected components of an undirected graph given as a table of links.

Alternating large-star and small-star steps: each is one grouped minimum and
one join on the node, so no group of neighbours is ever collected. A node with
very many links is a hot key of a join whose other side has one row a node,
which adaptive execution splits; the minimum is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import saved


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One step over links (a, b). large: every larger neighbour of a node
    moves to the node's least neighbour; small: node and smaller neighbours do."""
    if small:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        around = links.union(links.select("b", "a"))
    least = around.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    joined = around.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): component
    is the smallest node that it reaches. Links with a null end or from a node
    to itself are ignored; an empty table gives an empty result.

    Runs Spark jobs when called: each round is checkpointed.
    """
    edges = saved(links.select("a", "b").where("a != b").distinct())
    seal = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == seal:
            break
        seal = (row.n, row.s)
        if not row.n:
            break
        edges = saved(_star(_star(edges, small=False), small=True))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())
