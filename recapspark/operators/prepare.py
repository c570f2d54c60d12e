"""From capture files to clean, classified capture records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recapspark.config import DAYS_PER_MONTH, MAIN_RIVER, SIZE_CUTOFFS
from recapspark.functions import predicates, scalar
from recapspark.operators.dedup import remove_same_day, same_day_facts
from recapspark.operators.levels import number_levels
from recapspark.operators.storage import stored
from recapspark.operators.skew import CAPTURE_SPREAD, attach_facts
from recapspark.sources.schema import CAPTURE_COLUMNS


def union_captures(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both files by column name; the second may lack columns, not add any."""
    extra = sorted(set(second.columns) - set(first.columns))
    if extra:
        raise ValueError(f"columns missing in the first file: {extra}")
    return first.unionByName(second, allowMissingColumns=True)


def derive_captures(raw: DataFrame) -> DataFrame:
    """Pick the capture columns and derive date, time, species and tag."""
    raw = raw.withColumnRenamed("Mark PreCd", "MarkPreCd").select(*CAPTURE_COLUMNS)
    day, clock = scalar.parse_day(F.col("Date")), scalar.parse_clock(F.col("Time"))
    return raw.select(
        *[F.col(c) for c in CAPTURE_COLUMNS if c not in ("Date", "Time")],
        F.col("Date").cast("string").alias("dateC"),
        clock.alias("time"),
        day.alias("date"),
        scalar.species_name(F.col("SpeciesCd")).alias("species"),
        scalar.tag_of(F.col("MarkAppCd"), F.col("MarkPreCd")).alias("tag"),
        F.lit(1).alias("enc"),
    ).withColumns(
        {
            "dateYM": scalar.year_month(F.col("date")),
            "dateTime": scalar.day_and_clock(F.col("date"), F.col("time")),
        }
    )


def remove_untagged(captures: DataFrame) -> DataFrame:
    """Drop captures without a tag that identifies the fish."""
    return captures.filter(predicates.is_tagged())


def remove_uncaptured(captures: DataFrame) -> DataFrame:
    """Drop (date, tag) groups without rows: a group that exists has a row, so none."""
    return captures


def classify(
    captures: DataFrame,
    main_river: str = MAIN_RIVER,
    size_cutoffs: tuple[float, float] = SIZE_CUTOFFS,
) -> DataFrame:
    """Add river class, size class and the combined state."""
    return captures.withColumns(
        {
            "mainTrib": scalar.main_or_trib(F.col("Water"), main_river),
            "mainTribN": scalar.main_or_trib_number(F.col("Water"), main_river),
            "sizeState": scalar.size_state(F.col("Length"), size_cutoffs),
        }
    ).withColumn(
        "state", scalar.combined_state(F.col("sizeState"), F.col("mainTribN"))
    )


def month_intervals(captures: DataFrame) -> DataFrame:
    """One row per sampling month: occasion number, median date, time to the next.

    Captures are first counted per day, so all later steps see at most one row per
    calendar day (four-digit years: fewer than 3.7 million) and the result at most
    one row per month (fewer than 120,000). The median is exact: the mean of the two
    middle capture dates, found by running counts over the days of a month.
    """
    days = (
        captures.filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("date", scalar.year_month(F.col("date")).alias("dateYM"), "n")
    )
    in_month = Window.partitionBy("dateYM")
    days = days.select(
        "dateYM",
        F.unix_date("date").alias("day"),
        F.sum("n").over(in_month.orderBy("date")).alias("upto"),
        F.sum("n").over(in_month).alias("total"),
    )
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor(F.col("total") / 2) + 1
    medians = days.groupBy("dateYM").agg(
        (
            (
                F.min(F.when(F.col("upto") >= low, F.col("day")))
                + F.min(F.when(F.col("upto") >= high, F.col("day")))
            )
            / 2
        ).alias("dateMedian")
    )
    by_month = Window.orderBy("dateYM")
    gap = F.lead("dateMedian").over(by_month) - F.col("dateMedian")
    return medians.select(
        "dateYM",
        F.row_number().over(by_month).alias("occ"),
        "dateMedian",
        gap.alias("dateMedianDiff"),
        (gap / DAYS_PER_MONTH).alias("dateMedianDiffMonth"),
    )


def median_details(intervals: DataFrame) -> DataFrame:
    """Month medians with the day of month of the median and the month's first day."""
    return intervals.withColumns(
        {
            "dayMedian": F.dayofmonth(
                F.date_from_unix_date(F.floor("dateMedian").cast("int"))
            ),
            "date": scalar.month_start(F.col("dateYM")),
        }
    )


def join_month_intervals(
    captures: DataFrame, intervals: DataFrame | None = None
) -> DataFrame:
    """Add occasion number and interval columns by sampling month."""
    intervals = month_intervals(captures) if intervals is None else intervals
    # fewer than 120,000 months, see month_intervals
    return captures.join(F.broadcast(intervals.drop("dateMedian")), "dateYM", "left")


def add_river_number(captures: DataFrame, column: str = "Water") -> DataFrame:
    """Number the rivers in byte order of their names."""
    rivers, small = number_levels(captures, column, "riverN")
    if small:
        return captures.join(F.broadcast(rivers), column, "left")
    weights = captures.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return attach_facts(
        captures,
        weights.join(rivers, column, "left"),
        [column],
        ["riverN"],
        "n",
        ("tag", *CAPTURE_SPREAD),
    )


def first_last_facts(captures: DataFrame) -> DataFrame:
    """Per tag: first and last occasion on which the fish is known to be alive.

    A capture row always has ``enc = 1``, so every row counts as known.
    """
    return captures.groupBy("tag").agg(
        F.min("occ").alias("firstObserved"),
        F.max("occ").alias("lastObserved"),
        F.count(F.lit(1)).alias("n"),
    )


def add_first_last(
    captures: DataFrame, drop_same_day: bool = False, **skew
) -> DataFrame:
    """Add first/last occasion of the fish and whether the row is one of them.

    ``drop_same_day`` removes all rows of fish caught more than once on a day in the
    same pass over the rows.
    """
    if drop_same_day:
        facts = same_day_facts(captures)
        payload, keep = ["firstObserved", "lastObserved", "sameDay"], ~F.col("sameDay")
    else:
        facts = first_last_facts(captures)
        payload, keep = ["firstObserved", "lastObserved"], None
    out = attach_facts(
        captures, facts, ["tag"], payload, "n", CAPTURE_SPREAD, keep, **skew
    )
    return out.drop("sameDay").withColumns(
        {
            "knownZ": F.lit(1),
            "isFirstObserved": F.col("occ") == F.col("firstObserved"),
            "isLastObserved": F.col("occ") == F.col("lastObserved"),
        }
    )


def prepare_captures(
    derived: DataFrame,
    main_river: str = MAIN_RIVER,
    size_cutoffs: tuple[float, float] = SIZE_CUTOFFS,
    occasions: bool = True,
    river_number: bool = True,
    first_last: bool = True,
    drop_same_day: bool = False,
    **skew,
) -> DataFrame:
    """All captures of tagged fish with every derived column.

    ``occasions`` (month number and intervals), ``river_number`` and ``first_last``
    (needs the occasions) can be left out by an analysis that does not read those
    columns; each costs a pass over the captures.
    """
    if first_last and not occasions:
        raise ValueError("first and last occasion need the occasions")
    d = remove_uncaptured(remove_untagged(derived))
    d = classify(d, main_river, size_cutoffs)
    if occasions:
        # one row per month, read again by every step that needs occasions
        d = join_month_intervals(d, stored(month_intervals(d)))
    if river_number:
        d = add_river_number(d)
    if first_last:
        d = add_first_last(d, drop_same_day, **skew)
    elif drop_same_day:
        d = remove_same_day(d, **skew)
    return d
