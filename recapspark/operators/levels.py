"""Numbering the distinct values of a column 1, 2, 3, ... in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recapspark.config import BROADCAST_LEVELS
from recapspark.operators.storage import stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low bits


def number_levels(
    df: DataFrame, column: str, number: str, limit: int = BROADCAST_LEVELS
) -> tuple[DataFrame, bool]:
    """Distinct non-NULL values of ``column`` with their rank; second: is it small?

    A small set (counted, at most ``limit``) is ranked in one task and may be
    broadcast. A larger one is sorted by range over the cluster: every value knows
    its place within its range, and the sizes of the ranges give the offset.
    """
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    levels = stored(levels)
    if levels.count() <= limit:
        rank = F.row_number().over(Window.orderBy(column))
        return levels.withColumn(number, rank), True

    mono = F.monotonically_increasing_id()
    placed = stored(
        levels.orderBy(column).select(
            column,
            F.shiftright(mono, _ROW_BITS).alias("_range"),
            mono.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_place"),
        )
    )
    offsets = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per sorted range, that is per shuffle partition
    offsets = offsets.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    ranked = placed.join(F.broadcast(offsets), "_range").select(
        column, (F.col("_before") + F.col("_place") + 1).cast("int").alias(number)
    )
    return ranked, False
