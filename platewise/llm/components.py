"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.skew import join_side
from platewise.llm.common import checkpointed


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that is not the smallest of its
    component; ``root`` is the smallest.

    Alternating large and small stars: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows of. The number of rounds is about the
    logarithm of the longest path. Each round is two aggregates and joins whose hot
    nodes Spark can split, and ends in a checkpoint; only one row about it, count and
    checksum, comes to the driver.
    """
    edges = _tidy(edges.select("a", "b"))
    edges = checkpointed(edges)
    before = _state(edges)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger node first; no loops."""
    return (
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    return _tidy(
        both.join(join_side(smallest), "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(join_side(smallest), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = smallest.select("a", F.col("m").alias("b"))
    return _tidy(handed.unionByName(own))
