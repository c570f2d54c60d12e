"""Fish caught more than once on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.functions import predicates
from recapspark.operators.skew import CAPTURE_SPREAD, attach_facts


def captures_per_day(captures: DataFrame) -> DataFrame:
    """Number of captures per (date, tag)."""
    return captures.groupBy("date", "tag").agg(F.count(F.lit(1)).alias("n"))


def gt_one_capture(captures: DataFrame) -> DataFrame:
    """(date, tag) with more than one capture; an unknown date is a group too."""
    return captures_per_day(captures.filter(predicates.is_tagged())).filter("n > 1")


def same_day_facts(captures: DataFrame) -> DataFrame:
    """Per tag: row count, first/last occasion, undated rows, and removal (``sameDay``).

    A fish is removed if it has more than one capture on some date (known or not)
    and a capture on a date on which any fish has more than one. The two conditions
    are independent of each other, as in the published analysis.

    Everything is computed from counts per (tag, date). The dates with a double are
    at most one row per calendar day and are broadcast.
    """
    # The occasion follows from the date. As a key it adds no groups, and unlike a
    # measure it stays in both uses of the counts, which Spark therefore runs once.
    occ = F.col("occ") if "occ" in captures.columns else F.lit(None).cast("int")
    return _facts(
        captures.groupBy("tag", "date", occ.alias("occ")).agg(F.count(F.lit(1)).alias("n"))
    )


def with_double_dates(days: DataFrame) -> DataFrame:
    """Add to counts ``n`` per fish and date whether any fish has a double on the date.

    ``days`` is used twice. Whoever calls has to keep both uses one plan, see below.
    """
    # An unknown date stays in here and is ruled out below: filtering it would give
    # this branch a scan of its own instead of the counts computed above.
    # The same holds for the columns: "n > 0" is true, but Spark has to keep what comes with it.
    every_column = (F.col("n") > 0) | (F.xxhash64(*days.columns) == 0)
    double_dates = (
        days.filter((F.col("n") > 1) & every_column)
        .select(F.col("date").alias("_date"), F.lit(True).alias("_double"))
        .distinct()
    )
    on_double_date = F.col("_double").isNotNull() & F.col("date").isNotNull()
    return days.join(
        F.broadcast(double_dates), F.col("date").eqNullSafe(F.col("_date")), "left"
    ).select(*days.columns, on_double_date.alias("onDoubleDate"))


def _facts(days: DataFrame) -> DataFrame:
    return with_double_dates(days).groupBy("tag").agg(
        F.sum("n").alias("n"),
        F.min("occ").alias("firstObserved"),
        F.max("occ").alias("lastObserved"),
        F.bool_or(F.col("date").isNull()).alias("undated"),
        (F.bool_or(F.col("n") > 1) & F.bool_or("onDoubleDate")).alias("sameDay"),
    )


def kept_counts(captures: DataFrame, *by: str) -> DataFrame:
    """Captures ``n`` per fish and columns ``by`` of all fish that :func:`remove_same_day` keeps.

    The captures are read once, folded by fish, date and ``by``; what to remove and what to
    count both start from there, and whole fish leave the counts instead of the rows. Captures
    without the removed fish give the same counts.
    """
    columns = [c for c in by if c not in ("tag", "date")]
    cells = captures.groupBy("tag", "date", *columns).agg(F.count(F.lit(1)).alias("n"))
    days = cells.groupBy("tag", "date", F.lit(None).cast("int").alias("occ")).agg(
        F.sum("n").alias("n")
    )
    gone = _facts(days).filter("sameDay").select(F.col("tag").alias("_gone"))
    per_fish = cells.groupBy("tag", *[c for c in by if c != "tag"]).agg(F.sum("n").alias("n"))
    # null-safe: with = Spark would put "is not NULL" below one use of the cells only
    return per_fish.join(gone, F.col("tag").eqNullSafe(F.col("_gone")), "left_anti")


def gt_once_per_day_tags(captures: DataFrame) -> DataFrame:
    """Tags of the fish to remove."""
    return same_day_facts(captures).filter("sameDay").select("tag")


def remove_same_day(captures: DataFrame, **skew) -> DataFrame:
    """Drop every row of a fish that was ever caught more than once on a day."""
    return attach_facts(
        captures,
        same_day_facts(captures),
        ["tag"],
        ["sameDay"],
        "n",
        CAPTURE_SPREAD,
        ~F.col("sameDay"),
        **skew,
    ).drop("sameDay")
