"""Row-wise derivations of a capture record."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from recapspark.config import MAIN_RIVER, SIZE_CUTOFFS, SPECIES_CODES


# day, month number or name, year with four or two digits; any or no separator, but at most
# one dash between two of them: a second one is the sign of what follows
_GAP = r"[\s./,]*-?[\s./,]*"
_DAY_TEXT = (
    rf"^\s*(\d{{1,2}}){_GAP}(\d{{1,2}}|[A-Za-z]{{3,9}}){_GAP}(\d{{4}}|\d{{2}})\s*$|^.*$"
)

_USUAL_DAY = r"^ *\d{1,2}-\d{1,2}-\d{4} *$"


def parse_day(text: Column) -> Column:
    """Day-month-year text to a date; month as number or English name, NULL if unreadable.

    A two-digit year 00-68 is 20xx, 69-99 is 19xx. Numbers with dashes, the usual form,
    are parsed directly; only other text is rewritten first. Unreadable text becomes
    empty then, and a signed year never gets through, so every date has a four-digit
    year. Catalyst copies this expression into each pushed-down filter: keep it short.
    """
    usual = F.when(F.rlike(text, F.lit(_USUAL_DAY)), F.try_to_date(F.trim(text), "d-M-yyyy"))
    t = F.regexp_replace(text, _DAY_TEXT, "$1-$2-$3")
    t = F.regexp_replace(t, r"-([0-5]\d|6[0-8])$", "-20$1")
    t = F.regexp_replace(t, r"-(\d{2})$", "-19$1")
    return F.coalesce(usual, F.try_to_date(t, "d-[MMMM][MMM][M]-yyyy"))


def parse_clock(text: Column) -> Column:
    """``H:M:S`` text to a day-time interval, NULL if unreadable."""
    return F.trim(text).try_cast("interval hour to second").cast("interval day to second")


def day_and_clock(day: Column, clock: Column) -> Column:
    """Date plus time of day, without a time zone; NULL if either is missing."""
    return day.cast("timestamp_ntz") + clock


def year_month(day: Column) -> Column:
    """Sampling month ``yyyy-MM`` of a date."""
    return F.date_format(day, "yyyy-MM")


def year_of(month_text: Column) -> Column:
    """Year number of a ``yyyy-MM`` text."""
    return F.substring(month_text, 1, 4).cast("int")


def month_of(month_text: Column) -> Column:
    """Month number of a ``yyyy-MM`` text."""
    return F.substring(month_text, 6, 2).cast("int")


def month_start(month_text: Column) -> Column:
    """First day of a ``yyyy-MM`` month."""
    return F.to_date(F.concat(month_text, F.lit("-01")), "yyyy-MM-dd")


def occasion_column(month_text: Column) -> Column:
    """Name of the wide column of a month, ``date_<yyyy-MM>``; ``date_NA`` if undated."""
    return F.concat(F.lit("date_"), F.coalesce(month_text, F.lit("NA")))


def year_of_column(column_name: Column) -> Column:
    """Year number out of a wide column name."""
    return F.regexp_extract(column_name, r"^date_(\d{4})-(\d{2})$", 1).try_cast("int")


def month_of_column(column_name: Column) -> Column:
    """Month number out of a wide column name."""
    return F.regexp_extract(column_name, r"^date_(\d{4})-(\d{2})$", 2).try_cast("int")


def species_name(code: Column) -> Column:
    """Species of a numeric code; other codes are NULL."""
    (first, name), *rest = SPECIES_CODES.items()
    out = F.when(code == first, name)
    for value, name in rest:
        out = out.when(code == value, name)
    return out


def tag_of(applied: Column, already_present: Column) -> Column:
    """Lower-case tag: the mark applied, else the mark the fish already carried."""
    return F.lower(F.coalesce(applied, already_present))


def main_or_trib(water: Column, main_river: str = MAIN_RIVER) -> Column:
    """``main`` for the main river, ``trib`` for any other, NULL if unknown."""
    return F.when(water == main_river, "main").when(water.isNotNull(), "trib")


def main_or_trib_number(water: Column, main_river: str = MAIN_RIVER) -> Column:
    """1 for the main river, 2 for any other, NULL if unknown."""
    return F.when(water == main_river, 1).when(water.isNotNull(), 2)


def size_state(
    length: Column, cutoffs: tuple[float, float] = SIZE_CUTOFFS
) -> Column:
    """Size class 1, 2 or 3 by two cutoffs ("less than"), NULL if unmeasured."""
    small, medium = cutoffs
    return (
        F.when(length < small, 1)
        .when(length < medium, 2)
        .when(length.isNotNull(), 3)
    )


def combined_state(size: Column, main_trib_number: Column) -> Column:
    """State 1-3 in the main river, 4-6 in tributaries."""
    return size + (main_trib_number - 1) * 3


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def ilogit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def monthly_survival(phi: Column, months: Column, per_month: bool = False) -> Column:
    """``phi ^ months`` as the model states it; ``per_month`` gives ``phi ^ (1/months)``."""
    return F.pow(phi, F.try_divide(F.lit(1.0), months) if per_month else months)


def paste(*columns: Column, sep: str = "_") -> Column:
    """Join values as text."""
    return F.concat_ws(sep, *[c.cast("string") for c in columns])


#: Beyond this many degrees of freedom Student's quantile comes from its expansion.
_LARGE_DF = 400


def student_quantile(df: Column, level: float = 0.95) -> Column:
    """The value that bounds Student's t within ``level``, both sides; whole degrees of freedom.

    For whole ones the share within ``sqrt(df) * tan(angle)`` is a finite sum in the angle,
    which is halved down to the limits of a double. Many degrees of freedom use the
    expansion around the normal quantile, there exact to 1e-9. NULL below one.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
    ]
    far = F.lit(z)
    for i, term in enumerate(terms, 1):
        far = far + term / F.pow(df, F.lit(i))
    odd = F.pmod(df.cast("int"), F.lit(2)) == 1
    some = F.least(df, F.lit(_LARGE_DF)).cast("int")
    count = F.when(odd, F.floor((some - 1) / 2)).otherwise(F.floor(some / 2)).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    def within(angle):
        cosine = F.cos(angle)
        start = F.struct(
            F.lit(0.0).alias("sum"), F.when(odd, cosine).otherwise(F.lit(1.0)).alias("term")
        )

        def add(s, j):
            ratio = F.when(odd, 2.0 * j / (2 * j + 1)).otherwise((2.0 * j - 1) / (2 * j))
            return F.struct(
                (s["sum"] + s["term"]).alias("sum"), (s["term"] * cosine * cosine * ratio).alias("term")
            )

        total = F.sin(angle) * F.aggregate(steps, start, add, lambda s: s["sum"])
        return F.when(odd, (angle + total) * 2 / math.pi).otherwise(total)

    def halve(s, _):
        middle = (s["low"] + s["high"]) / 2
        below = within(middle) < level
        return F.struct(
            F.when(below, middle).otherwise(s["low"]).alias("low"),
            F.when(below, s["high"]).otherwise(middle).alias("high"),
        )

    ends = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
    angle = F.aggregate(F.sequence(F.lit(1), F.lit(52)), ends, halve, lambda s: s["low"])
    near = F.sqrt(df) * F.tan(angle)
    return F.when(df > _LARGE_DF, far).when(df >= 1, near)
