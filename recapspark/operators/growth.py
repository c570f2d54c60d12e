"""Growth between successive captures of a fish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.functions import predicates, scalar
from recapspark.operators.dedup import with_double_dates
from recapspark.operators.storage import stored


def growth_rows(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add the previous length and date of the fish, days between, and mm per day.

    Expects captures without same-day doubles: a fish then has at most one row per
    calendar day, which bounds the window group of the dated rows. Undated rows come
    after them in FishNum order. Their growth is unknown, only the previous length
    and date are. As a fish may have any number of them, they are sorted over the cluster
    in ``ranges`` (as many as shuffle partitions if not given), and the first row of a fish in a
    range takes its values from the last one before that range.
    """
    d = captures.withColumns(
        {
            "year": scalar.year_of(F.col("dateYM")),
            "month": scalar.month_of(F.col("dateYM")),
        }
    )
    dated = d.filter(F.col("date").isNotNull())
    by_date = Window.partitionBy("tag").orderBy("date", "FishNum")
    dated_rows = dated.withColumns(
        {
            "LengthLag": F.lag("Length").over(by_date),
            "dateLag": F.lag("date").over(by_date),
        }
    )
    undated = d.filter(F.col("date").isNull())
    order = ["tag", "FishNum", "Length", F.xxhash64(*d.columns)]
    ordered = undated.repartitionByRange(*([ranges] if ranges else []), *order)
    # stored, as the borders of the ranges come from a sample
    undated = stored(ordered.withColumn("_slice", F.spark_partition_id().cast("long")), "undated")
    # The last row of every slice, and of the dated rows, per fish that has undated rows.
    lasts = (
        undated.groupBy("tag", "_slice")
        .agg(F.max(F.struct("FishNum", "Length")).alias("_last"))
        .select(
            "tag", "_slice", F.col("_last.Length").alias("_Length"),
            F.lit(None).cast("date").alias("_date"),
        )
    )
    last_dated = (
        dated.join(undated.select("tag").distinct(), "tag", "left_semi")
        .groupBy("tag")
        .agg(F.max(F.struct("date", "FishNum", "Length")).alias("_last"))
        .select(
            "tag", F.lit(None).cast("long").alias("_slice"),
            F.col("_last.Length").alias("_Length"), F.col("_last.date").alias("_date"),
        )
    )
    by_slice = Window.partitionBy("tag").orderBy(F.asc_nulls_first("_slice"))
    carry = (
        lasts.unionByName(last_dated)
        .select(
            "tag",
            "_slice",
            F.lag("_Length").over(by_slice).alias("_Length"),
            F.lag("_date").over(by_slice).alias("_date"),
        )
        .filter(F.col("_slice").isNotNull())
    )
    in_slice = Window.partitionBy("tag", "_slice").orderBy("FishNum", "Length")
    undated_rows = (
        undated.withColumns(
            {
                "_row": F.row_number().over(in_slice),
                "LengthLag": F.lag("Length").over(in_slice),
            }
        )
        .join(carry, ["tag", "_slice"], "left")
        .withColumns(
            {
                "LengthLag": F.when(F.col("_row") == 1, F.col("_Length")).otherwise(
                    F.col("LengthLag")
                ),
                "dateLag": F.when(F.col("_row") == 1, F.col("_date")),
            }
        )
        .select(*dated_rows.columns)
    )
    return _with_growth(dated_rows.unionByName(undated_rows))


def dated_growth(captures: DataFrame) -> DataFrame:
    """Growth per dated capture of fish without same-day doubles, from captures of any fish.

    ``(tag, date, year, month, mainTrib, sizeState, Length, LengthLag, dateLag, dateDiff, growth)``.
    The captures are read once and folded by fish and date. A fish is then bounded by the calendar,
    and one shuffle by fish serves its removal and its previous capture. A date of
    a fish that stays has one capture, so any aggregate is that capture's value; numbers
    keep the aggregation by hash.
    """
    days = captures.groupBy("tag", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("Length").alias("Length"),
        F.min("mainTribN").alias("mainTribN"),
        F.min("sizeState").alias("sizeState"),
    )
    fish = Window.partitionBy("tag")
    kept = (
        with_double_dates(days)
        .withColumn("_double", F.bool_or(F.col("n") > 1).over(fish))
        .withColumn("_shared", F.bool_or("onDoubleDate").over(fish))
        .filter(~(F.col("_double") & F.col("_shared")) & F.col("date").isNotNull())
    )
    by_date = fish.orderBy("date")
    rows = kept.select(
        "tag",
        "date",
        scalar.year_of(scalar.year_month(F.col("date"))).alias("year"),
        scalar.month_of(scalar.year_month(F.col("date"))).alias("month"),
        F.when(F.col("mainTribN") == 1, "main")
        .when(F.col("mainTribN") == 2, "trib")
        .alias("mainTrib"),
        "sizeState",
        "Length",
        F.lag("Length").over(by_date).alias("LengthLag"),
        F.lag("date").over(by_date).alias("dateLag"),
    )
    return _with_growth(rows)


def _with_growth(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("dateDiff", F.datediff("date", "dateLag").cast("double"))
    gain = F.col("Length") - F.col("LengthLag")
    return rows.withColumn("growth", F.try_divide(gain, F.col("dateDiff")))


def _summary(
    captures: DataFrame, keys: list[str], more_than: int, sd: bool, having: Column | None
) -> DataFrame:
    measures = [F.avg("growth").alias("mean")]
    if sd:
        measures.append(F.stddev_samp("growth").alias("sd"))
    out = (
        dated_growth(captures)
        .filter(predicates.plausible_growth())
        .groupBy(*keys)
        .agg(*measures, F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > more_than)
    )
    return out if having is None else out.filter(having)


def growth_by_month(
    captures: DataFrame, plot_range: tuple[float, float] | None = None
) -> DataFrame:
    """Mean growth per river class, year, month and size; ``plot_range`` clips the mean."""
    clip = None if plot_range is None else F.col("mean").between(*plot_range)
    return _summary(
        captures, ["mainTrib", "year", "month", "sizeState"], 3, False, clip
    )


def growth_by_size(
    captures: DataFrame, plot_range: tuple[float, float] | None = None
) -> DataFrame:
    """Mean and sd of growth per river class and size."""
    clip = None if plot_range is None else F.col("mean").between(*plot_range)
    return _summary(captures, ["mainTrib", "sizeState"], 5, True, clip)


def growth_by_size_year(
    captures: DataFrame, year: int | None = None, more_than: int = 5
) -> DataFrame:
    """Mean and sd of growth per river class, size and year, or of one year only."""
    one_year = None if year is None else F.col("year") == year
    return _summary(
        captures, ["mainTrib", "sizeState", "year"], more_than, True, one_year
    )


def growth_values(
    captures: DataFrame, year: int, main_trib: str, size_state: int
) -> DataFrame:
    """How often each growth value occurs in one cell (missing values left out)."""
    return (
        dated_growth(captures)
        .filter(
            (F.col("year") == year)
            & (F.col("mainTrib") == main_trib)
            & (F.col("sizeState") == size_state)
            & F.col("growth").isNotNull()
        )
        .groupBy("growth")
        .agg(F.count(F.lit(1)).alias("n"))
    )
