"""Running numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def running_number(
    df: DataFrame, keys: Sequence[str], order: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows of each group from 1 in the order of the integer ``order``,
    which is unique within a group.

    A plain window would put one whole group into one task. Here a group is cut
    into blocks of the order column: rows are numbered inside their block, and
    the number of rows in the blocks before is added. Those offsets come from
    counts that are combined before the shuffle. Groups of one block, that is
    all ordinary plates, have no offset row at all.
    """
    block, offset = "__block", "__offset"
    blocked = df.withColumn(block, F.floor(F.col(order) / F.lit(block_rows)))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(*keys, block, F.sum("__rows").over(earlier).alias(offset))
        .filter(F.col(offset).isNotNull())
    )
    inside = Window.partitionBy(*keys, block).orderBy(order)
    # Groups of a NULL key have offsets too.
    renamed = offsets.select(*[F.col(c).alias(f"__{c}") for c in (*keys, block)], offset)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, block)]
    return (
        blocked.withColumn(name, F.row_number().over(inside))
        .join(renamed, reduce(and_, same), "left")
        .withColumn(name, (F.col(name) + F.coalesce(F.col(offset), F.lit(0))).cast("int"))
        .select(*df.columns, name)
    )
