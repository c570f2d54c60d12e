"""Exact interpolated quantiles per group, whatever the size of a group."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.operators.storage import stored


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """``keys`` and ``quantiles``, an array with one value per entry of ``probs``.

    Linear interpolation between order statistics (type 7). NULL and NaN are ignored,
    infinities are ordinary ends of the order; between unlike infinities the result is NaN.

    Equal values are counted first, so ties cost one row. The distinct values are sorted by
    range over the cluster; how many lie below a range follows from the counts of the ranges, and a
    running sum inside a range finds the wanted ranks. No task holds a group.
    """
    keys = list(keys)
    df = clean_values(df.select(*keys, value), value)
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = stored(
        counted.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id())
    )
    names = [f"_g{i}" for i in range(len(keys))]
    group = Window.partitionBy(*keys)
    # one row per group and range that holds some of it
    below = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c")).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col("_range").alias("_r"),
        (F.sum("_c").over(group.orderBy("_range")) - F.col("_c")).alias("_below"),
        F.sum("_c").over(group).alias("_n"),
    )
    within = Window.partitionBy("_range", *keys).orderBy("_v")
    placed = ranged.withColumn("_upto", F.sum("_c").over(within)).join(
        below, (F.col("_range") == F.col("_r")) & _same(keys, names)
    )
    upto = F.col("_below") + F.col("_upto")
    picks = []
    for i, p in enumerate(probs):
        rank = (F.col("_n") - 1) * float(p)
        for side, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            hit = (at < upto) & (at >= upto - F.col("_c"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)

    def between(i, p):
        rank = (F.col("_n") - 1) * float(p)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        mixed = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
        return F.when(low == high, low).otherwise(mixed)

    return found.select(
        *keys, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("quantiles")
    )


def clean_values(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value, as double."""
    df = df.withColumn(value, F.col(value).cast("double"))
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value))


def _same(keys: Sequence[str], names: Sequence[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    pairs = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return reduce(operator.and_, pairs)
