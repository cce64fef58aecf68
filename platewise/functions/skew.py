"""Joins that adaptive execution can split when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_side(aggregated: DataFrame) -> DataFrame:
    """An aggregate as one side of a join on the keys it was grouped by.

    Spark would reuse the aggregate's own partitioning for the join, and then no
    longer split a hot key of the other side: it only splits joins between two
    plain shuffles. Rebalancing first gives the join a shuffle of its own. The
    aggregate is the small side, so that shuffle costs little.
    """
    return aggregated.hint("rebalance")
