"""Counts and contingency tables of captures."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapspark.config import HISTOGRAM_BINS, LEVEL_BLOCK, MODEL_SPECIES
from recapspark.operators.levels import number_levels
from recapspark.operators.storage import stored


def _number(weight: str | None) -> Column:
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")


def counts(df: DataFrame, *columns: str, weight: str | None = None) -> DataFrame:
    """Frequency of every combination of values; rows with a missing value are left out.

    ``weight`` names a column that says how many rows each row stands for.
    """
    known = reduce(operator.and_, [F.col(c).isNotNull() for c in columns])
    # Tied to the count, which is never below 1: Spark would move a filter of the columns alone
    # below the counting, and a source that is used twice would no longer be one plan.
    return df.groupBy(*columns).agg(_number(weight)).filter(known | (F.col("n") < 1))


def n_unique_tags(captures: DataFrame) -> DataFrame:
    """Number of different fish."""
    return captures.agg(F.countDistinct("tag").alias("nTags"))


def captures_per_fish(captures: DataFrame, *by: str, sort: bool = True) -> DataFrame:
    """Captures per fish and further columns (missing is a group), most first."""
    out = captures.filter(F.col("tag") != "").groupBy("tag", *by).agg(_number(None))
    return most_first(out, *by) if sort else out


def most_first(per_fish: DataFrame, *by: str) -> DataFrame:
    """Counts ``n`` per fish and columns ``by``, largest first."""
    return per_fish.orderBy(F.desc("n"), *[F.asc_nulls_last(c) for c in ("tag", *by)])


def contingency(df: DataFrame, rows: str, columns: str, block: int = LEVEL_BLOCK) -> DataFrame:
    """Two-way counts in long form, with the empty cells of the table as zeros.

    Levels of both sides are numbered and cut into ranges of ``block``; a task fills the cells of
    one pair of ranges, so no list of all levels exists anywhere, however many a side has.
    """
    cells = stored(counts(df, rows, columns), "cells")  # small, and used several times

    def ranges(column, number):
        levels, _ = number_levels(cells, column, number)
        levels = stored(levels.withColumn("_range", F.floor((F.col(number) - 1) / block).cast("int")))
        last = F.coalesce(levels.agg(F.max("_range")).scalar(), F.lit(-1))
        return levels.select(column, F.col("_range").alias(f"_{number}")), last

    left, last_left = ranges(rows, "r")
    right, last_right = ranges(columns, "c")

    def over(last):
        return F.when(last >= 0, F.sequence(F.lit(0), last))

    left = left.withColumn("_c", F.explode(over(last_right)))
    right = right.withColumn("_r", F.explode(over(last_left)))
    grid = left.join(right, ["_r", "_c"]).select(rows, columns)
    return grid.join(cells, [rows, columns], "left").fillna(0, ["n"])


def contingency_wide(
    df: DataFrame, rows: str, columns: str, levels: Sequence | None = None
) -> DataFrame:
    """The same counts with one column per level of ``columns``."""
    cells = df.dropna(subset=[rows, columns])
    return cells.groupBy(rows).pivot(columns, levels and list(levels)).count().fillna(0)


def length_histogram(
    captures: DataFrame,
    facet: str = "mainTrib",
    bins: int = HISTOGRAM_BINS,
    species: str = MODEL_SPECIES,
) -> DataFrame:
    """Body lengths of one species in equal bins over the common range, per facet.

    Bins are closed on the left; the largest length falls into the last one.
    """
    d = captures.filter(
        (F.col("species") == species) & F.col("Length").isNotNull()
    ).select(facet, "Length")
    ends = F.struct(F.min("Length").alias("low"), F.max("Length").alias("high"))
    d = d.withColumn("_ends", d.agg(ends).scalar())
    d = d.withColumns({"_low": F.col("_ends.low"), "_high": F.col("_ends.high")})
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.floor(F.try_divide(F.col("Length") - F.col("_low"), width))
    return (
        d.select(
            facet,
            F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"),
            "_low",
            width.alias("_width"),
        )
        .groupBy(facet, "bin", "_low", "_width")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            facet,
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("binStart"),
            "n",
        )
    )


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in a given order (a report, not a sample)."""
    return df.orderBy(*order).limit(n)
