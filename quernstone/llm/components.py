"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(pairs: DataFrame) -> DataFrame:
    """Give each row (node, other) the smallest of its node and all the node's others.

    A minimum and a join, never a list: a hub's rows may be split over many tasks.
    """
    low = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))
    return pairs.join(low, "node")


def large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
    )
    made = _star(both).filter("other > node").select(F.col("low").alias("u"), F.col("other").alias("v"))
    return made.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
    starred = _star(down)
    made = starred.filter("other <> low").select(F.col("low").alias("u"), F.col("other").alias("v")).unionByName(
        starred.select(F.col("low").alias("u"), F.col("node").alias("v"))
    )
    return made.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their smallest nodes: every node is a centre, or the end of one edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("end")).unionByName(edges.select(F.col("v").alias("node"), F.lit(1).alias("end")))
    seen = ends.groupBy("node").agg(F.sum("end").alias("ends"), F.min("end").alias("least"))
    return seen.filter("ends > 1 or (ends = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    ``edges`` has columns ``u, v`` of an ordered type, in either direction; loops, repeats and
    rows with nulls are ignored. Returns ``node, component``, one row for each node of an
    edge. Each round is checkpointed, so a lost executor costs one round at most.
    ``most_rounds`` only guards against a bug: the number needed grows with the square of
    the logarithm of the nodes, and running out of rounds is an error, never a short result.
    """
    now = edges.filter("u is not null and v is not null and u <> v")
    now = cut(now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    for _ in range(most_rounds):
        if _settled(now):
            break
        now = cut(small_star(large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
