"""Encounter histories: one row per fish, one position per sampling month.

The canonical form is sparse: per fish an array of the months in which it was caught
(:func:`caught_months`). Dense arrays (:func:`encounter_histories`), the long form
(:func:`history_long`) and wide columns (:func:`history_wide`) are unfolded from it
without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.config import EXCLUDED_TAGS, MODEL_SPECIES
from recapspark.functions import predicates, scalar
from recapspark.operators.skew import CAPTURE_SPREAD, attach_facts

#: Sorts behind every ``yyyy-MM``; stands for the month of undated captures.
UNDATED = "~"
#: Stands for all months that a declared wide table has no column for.
OTHER = "other"
_NO_TIME = "9999-12-31 23:59:59.999999"

INTERVAL = "dateMedianDiffMonth"

#: Columns carried into a history and the value of a month without a capture.
CELL_FILL = {
    "enc": 0,
    "Water": None,
    "riverN": 0,
    "state": 0,
    "sizeState": 0,
    INTERVAL: None,
}


# --- rules about single captures -------------------------------------------------


def never_captured(captures: DataFrame) -> DataFrame:
    """Tags whose encounters sum to zero."""
    return (
        captures.groupBy("tag")
        .agg(F.coalesce(F.sum("enc"), F.lit(0)).alias("sumEnc"))
        .filter("sumEnc = 0")
        .select("tag")
    )


def _last_occasion(captures: DataFrame) -> Column:
    """Largest occasion as a scalar subquery; NULL as soon as one occasion is missing."""
    return captures.agg(
        F.when(F.bool_or(F.col("occ").isNull()), None).otherwise(F.max("occ"))
    ).scalar()


def first_on_last_occasion(captures: DataFrame) -> DataFrame:
    """Tags first seen on the last occasion; none if any capture lacks its occasion."""
    last = _last_occasion(captures)
    return captures.filter(F.col("firstObserved") == last).select("tag").distinct()


def gt1_obs_per_occasion(captures: DataFrame) -> DataFrame:
    """(tag, month) with more than one capture."""
    return (
        captures.groupBy("tag", "dateYM")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def month_facts(captures: DataFrame) -> DataFrame:
    """Per (tag, month) what decides which of its captures stay.

    Captures are folded to months first, so the window over the months of a fish sees
    one row per month.
    """
    per_fish = Window.partitionBy("tag")
    months = captures.groupBy("tag", "dateYM").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("dateTime").isNull()).alias("_untimed"),
        F.max("dateTime").alias("_latest"),
        F.min(F.struct(*_order())).alias("_first"),
    )
    unclear = (F.col("n") > 1) & (F.col("_untimed") > 0)
    return months.withColumns(
        {
            "_n": F.col("n"),
            "_drop_untimed": F.bool_or(unclear).over(per_fish),
            "_first_month": F.min("dateYM").over(per_fish),
        }
    )


def _stays() -> Column:
    """Thinning rule in terms of :func:`month_facts`, never NULL."""
    latest = (F.col("_n") > 1) & (F.col("_untimed") == 0)
    latest = latest & (F.col("dateTime") == F.col("_latest"))
    return ~F.when(F.col("dateTime").isNull(), F.col("_drop_untimed")).otherwise(latest)


def _is_first() -> Column:
    return F.struct(*_order()) == F.col("_first")


def thin_occasions(captures: DataFrame, mode: str = "reference", **skew) -> DataFrame:
    """Thin out fish caught several times in a month.

    ``mode='reference'`` removes the capture(s) at the latest time of such a month, so
    two of three stay. Where a time is missing the latest is unknown: then all
    captures of that fish without a time go, in any month.
    ``mode='first'`` keeps the earliest capture of each month and nothing else.
    """
    keep, payload = _rule(mode)
    return _attach_and_keep(captures, month_facts(captures), keep, payload, skew)


def _rule(mode: str) -> tuple[Column, list[str]]:
    """The thinning rule and the month facts it reads."""
    if mode == "reference":
        return _stays(), ["_n", "_untimed", "_latest", "_drop_untimed"]
    if mode == "first":
        return _is_first(), ["_first"]
    raise ValueError("mode is 'reference' or 'first'")


def _attach_and_keep(captures, facts, keep, payload, skew):
    out = attach_facts(
        captures, facts, ["tag", "dateYM"], payload, "n", CAPTURE_SPREAD, keep, **skew
    )
    return out.drop(*payload)


def _order() -> list[Column]:
    """Capture order within a month: by time, unknown time last, then fish number."""
    far = F.lit(_NO_TIME).cast("timestamp_ntz")
    return [
        F.coalesce(F.col("dateTime"), far).alias("at"),
        F.coalesce(F.col("FishNum"), F.lit(2**63 - 1)).alias("FishNum"),
    ]


def history_rows(
    captures: DataFrame,
    cols: Sequence[str] = (),
    ops: Sequence[str] = (),
    vals: Sequence = (),
    mode: str = "reference",
    same_day: DataFrame | None = None,
    **skew,
) -> DataFrame:
    """Capture rows behind the histories, before the species filter.

    Fish first seen in the last month go and months are thinned before the river
    filter applies; both rules are facts of a fish's months, attached in one join. A
    fish without captures cannot have a row here. ``same_day`` are per-fish facts (see
    ``same_day_facts``): fish to be removed for same-day doubles leave in the same join.
    """
    facts = month_facts(captures)
    if same_day is None:
        last = facts.agg(
            F.when(F.bool_or(F.col("dateYM").isNull()), None).otherwise(F.max("dateYM"))
        )
        late = F.coalesce(F.col("_first_month") == last.scalar(), F.lit(False))
        facts = facts.withColumn("_removed", late)
    else:
        if "occ" not in captures.columns:
            raise ValueError("same_day needs captures with occasions")
        last = same_day.filter(~F.col("sameDay")).agg(
            F.when(F.bool_or("undated"), None).otherwise(F.max("lastObserved"))
        )
        late = F.coalesce(F.col("firstObserved") == last.scalar(), F.lit(False))
        removed = same_day.select("tag", (F.col("sameDay") | late).alias("_removed"))
        facts = facts.join(removed, "tag")
    keep, payload = _rule(mode)
    keep, payload = ~F.col("_removed") & keep, [*payload, "_removed"]
    out = _attach_and_keep(captures, facts, keep, payload, skew)
    return out.filter(predicates.all_of(cols, ops, vals))


def month_medians_of(rows: DataFrame) -> DataFrame:
    """Sampling months of ``rows`` with the months until the next one."""
    return rows.select("dateYM", "dateMedianDiffMonth").distinct()


def n_size_states(rows: DataFrame) -> DataFrame:
    """Number of different size states; a missing one counts as a state."""
    return rows.agg(
        (
            F.countDistinct("sizeState")
            + F.coalesce(F.max(F.col("sizeState").isNull().cast("int")), F.lit(0))
        )
        .cast("int")
        .alias("nStates")
    )


# --- histories -------------------------------------------------------------------


def fold_months(
    captures: DataFrame,
    subsets: dict[str, tuple[Sequence[str], Sequence[str], Sequence]],
    species: str = MODEL_SPECIES,
    excluded_tags: Sequence[str] = EXCLUDED_TAGS,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (tag, month): counts, and per subset the cell that its histories show there.

    A fish with very many captures is spread over its months before it meets its fish-level
    row, and a stored fold serves the histories of all subsets. ``subsets`` maps a name to a
    dynamic filter (columns, operators, values); the cell is ``cell_<name>``.
    """
    if values is None:
        values = [c for c in CELL_FILL if c in captures.columns and c != INTERVAL]
    enters = predicates.enters_histories(species, excluded_tags)
    cell = F.struct(*_order(), "dateTime", *values)
    return captures.groupBy("tag", "dateYM").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("dateTime").isNull()).alias("untimed"),
        F.max("dateTime").alias("latest"),
        F.sum("enc").alias("enc"),
        *[
            F.min(F.when(predicates.all_of(*rule) & enters, cell)).alias(f"cell_{name}")
            for name, rule in subsets.items()
        ],
    )


def caught_months(
    captures: DataFrame,
    cols: Sequence[str] = (),
    ops: Sequence[str] = (),
    vals: Sequence = (),
    species: str = MODEL_SPECIES,
    excluded_tags: Sequence[str] = EXCLUDED_TAGS,
    drop: DataFrame | None = None,
    intervals: DataFrame | None = None,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """The months of a fish's history straight from captures, see :func:`caught_of_months`."""
    rule = {"own": (cols, ops, vals)}
    months = fold_months(captures, rule, species, excluded_tags, values)
    return caught_of_months(months, "own", drop, intervals)


def caught_of_months(
    months: DataFrame,
    subset: str,
    drop: DataFrame | None = None,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """Per fish the months of its history: ``tag``, ``cells``, ``months``, ``intervals``.

    ``months`` is a fold of captures (:func:`fold_months`). ``cells`` is sorted by month and
    holds what the wide table shows there. The result's ``months``
    are the columns of the whole table: the months in which any fish of the subset has
    a cell, undated captures (if any) last. Its ``intervals`` has the months until the next
    sampling month for each of them, if ``intervals`` (see ``month_intervals``) is given.

    The removal rules work on the folded rows. That is possible because the cell shows the
    earliest capture of the
    subset: it survives the thinning of the month exactly if any other one does. So no
    row-level join is needed.

    Everything about a fish goes into one list. The largest month and the list of
    months are then read from the same aggregation as the result, which Spark runs once.
    A fold stored by tag needs no shuffle for that.

    ``drop``: tags to leave out entirely (see ``gt_once_per_day_tags``). Whole fish
    leave, so this may happen after the folding, on one row per fish.
    """
    kept = f"cell_{subset}"
    names = months.schema[kept].dataType.names
    values = [n for n in names if n in CELL_FILL]
    months = months.withColumn("cell", F.col(kept))
    time = F.col("cell.dateTime")
    survives = F.col("cell").isNotNull() & (
        time.isNull()
        | (F.col("n") == 1)
        | (F.col("untimed") > 0)
        | (time < F.col("latest"))
    )
    entry = F.struct(
        F.coalesce("dateYM", F.lit(UNDATED)).alias("month"),
        ((F.col("n") > 1) & (F.col("untimed") > 0)).alias("unclear"),
        F.coalesce("enc", F.lit(0)).alias("caught"),
        survives.alias("shown"),
        time.isNull().alias("untimed"),
        *[F.col(f"cell.{v}").alias(v) for v in values],
    )
    fish = months.groupBy("tag").agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )
    if drop is not None:
        fish = fish.join(drop.select("tag"), "tag", "left_anti")
    # an undated capture sorts last and leaves the last month unknown
    last = fish.agg(F.max(F.element_at("entries", -1)["month"])).scalar()
    last = F.nullif(last, F.lit(UNDATED))
    shown = F.filter(
        "entries",
        lambda e: e["shown"]
        & ~(e["untimed"] & F.exists("entries", lambda o: o["unclear"])),
    )
    cells = F.transform(
        shown, lambda e: F.struct(e["month"].alias("month"), *[e[v].alias(v) for v in values])
    )
    fish = fish.filter(
        F.exists("entries", lambda e: e["caught"] > 0)
        & ~F.coalesce(F.element_at("entries", 1)["month"] == last, F.lit(False))
    )
    fish = fish.select("tag", cells.alias("cells")).filter(F.size("cells") > 0)
    present = fish.select(F.explode("cells.month").alias("month")).distinct()
    gap = F.lit(None).cast("double")
    if intervals is not None:
        gaps = intervals.select(F.col("dateYM").alias("month"), INTERVAL)
        present, gap = present.join(F.broadcast(gaps), "month", "left"), F.col(INTERVAL)
    columns = present.agg(
        F.array_sort(F.collect_list(F.struct("month", gap.alias("gap"))))
    ).scalar()
    return fish.withColumn("columns", columns).select(
        "tag",
        "cells",
        F.col("columns.month").alias("months"),
        F.col("columns.gap").alias("intervals"),
    )


def _cell_values(caught: DataFrame) -> list[str]:
    names = caught.schema["cells"].dataType.elementType.names
    return [n for n in names if n != "month"]


def history_cells(caught: DataFrame) -> DataFrame:
    """Filled cells only: (tag, j, dateYM, values...), ``j`` counts the table's months."""
    return (
        caught.select("tag", "months", "intervals", F.explode("cells").alias("c"))
        .withColumn("j", F.array_position("months", F.col("c.month")).cast("int"))
        .select(
            "tag",
            "j",
            _month_text(F.col("c.month")).alias("dateYM"),
            *[F.col(f"c.{n}").alias(n) for n in _cell_values(caught)],
            F.element_at("intervals", F.col("j")).alias(INTERVAL),
        )
    )


def _month_text(month: Column) -> Column:
    return F.nullif(month, F.lit(UNDATED))


def encounter_histories(caught: DataFrame) -> DataFrame:
    """Dense arrays per fish: ``tag, first, last, months, y_<value>...``.

    ``first`` is the position of the first capture, ``last`` the number of months.
    A cell without a capture gets the fill value, a captured but missing value stays
    NULL. Each array is laid out as runs: the gap before a cell, then the cell.
    """
    kinds = caught.schema["cells"].dataType.elementType
    d = caught.withColumn(
        "_at",
        F.transform(
            "cells", lambda c: F.array_position("months", c["month"]).cast("int")
        ),
    ).withColumn("last", F.size("months"))

    def dense(name, kind, value):
        fill = F.lit(CELL_FILL.get(name)).cast(kind)

        def run(cell, i):
            before = F.when(i == 0, 0).otherwise(F.get("_at", i - 1))
            gap = F.get("_at", i) - 1 - before
            return F.concat(F.array_repeat(fill, gap), F.array(value(cell, i)))

        tail = F.array_repeat(fill, F.col("last") - F.element_at("_at", -1))
        runs = F.flatten(F.transform("cells", run))
        return F.concat(runs, tail).alias(f"y_{name}")

    return d.select(
        "tag",
        F.element_at("_at", 1).alias("first"),
        "last",
        F.transform("months", _month_text).alias("months"),
        *[
            dense(n, kinds[n].dataType, lambda c, i, n=n: c[n])
            for n in _cell_values(caught)
        ],
        dense(INTERVAL, "double", lambda c, i: F.get("intervals", F.get("_at", i) - 1)),
    )


def history_long(histories: DataFrame) -> DataFrame:
    """Dense long form ``(tag, j, dateYM, values...)``, filled cells and empty ones."""
    names = [c for c in histories.columns if c.startswith("y_")]
    zipped = F.arrays_zip("months", *names)
    return histories.select("tag", F.posexplode(zipped).alias("p", "c")).select(
        "tag",
        (F.col("p") + 1).alias("j"),
        F.col("c.months").alias("dateYM"),
        *[F.col(f"c.{n}").alias(n[2:]) for n in names],
    )


def history_wide(
    histories: DataFrame, value: str = "enc", months: Sequence[str | None] | None = None
) -> DataFrame:
    """Wide form: one row per fish, columns ``date_<yyyy-MM>`` in month order.

    ``months`` declares the columns, None standing for undated captures (``date_NA``); no
    job is needed to learn them. A declared month that nobody was caught in shows the fill value.
    A captured cell outside of them stops the query with an error that names the fish and the month,
    unless ``OTHER`` is declared: then ``date_other`` lists those cells as ``month:value``, in month
    order, comma-joined; NULL if there are none.

    Without ``months`` the columns are data: all months of the first history (every history
    has the same), so ``histories`` should be stored by then.
    """
    if months is None:
        row = histories.select("months").first()
        months = [] if row is None else row["months"]
        return histories.select(
            "tag",
            *[
                F.get(f"y_{value}", F.lit(i)).alias(f"date_{m or 'NA'}")
                for i, m in enumerate(months)
            ],
        )
    own = F.transform("months", lambda m: F.coalesce(m, F.lit(UNDATED)))
    named = [m or UNDATED for m in months if m != OTHER]
    declared = F.array(*map(F.lit, named)).cast("array<string>")
    fill = F.lit(CELL_FILL.get(value))
    cells = F.arrays_zip(own.alias("m"), F.col("y_enc").alias("e"), F.col(f"y_{value}").alias("v"))
    outside = F.filter(cells, lambda c: (c["e"] > 0) & ~F.array_contains(declared, c["m"]))
    month = F.get(F.transform(outside, lambda c: c["m"]), F.lit(0))
    message = F.concat_ws(" ", F.lit("captured outside the declared months:"), "tag", month)
    text = F.transform(
        outside, lambda c: F.concat(c["m"], F.lit(":"), F.coalesce(c["v"].cast("string"), F.lit("NA")))
    )
    tag = F.col("tag")
    if OTHER not in months:
        tag = F.when(F.size(outside) > 0, F.raise_error(message)).otherwise(tag).alias("tag")

    def shown(month):
        place = F.array_position(own, month).cast("int")
        return F.when(place > 0, F.get(f"y_{value}", place - 1)).otherwise(fill)

    return histories.select(
        tag,
        F.transform(declared, shown).alias("_shown"),
        F.nullif(F.array_join(text, ","), F.lit("")).alias("_other"),
    ).select(
        "tag",
        *[
            (F.col("_other") if m == OTHER else F.get("_shown", F.lit(named.index(m or UNDATED))))
            .alias(f"date_{m or 'NA'}")
            for m in months
        ],
    )


def pivot_captures(
    captures: DataFrame, value: str, months: Sequence[str], species: str = MODEL_SPECIES
) -> DataFrame:
    """Wide form straight from captures, for a given list of months (no thinning)."""
    rows = captures.filter(predicates.enters_histories(species))
    cells = (
        rows.groupBy("tag")
        .pivot("dateYM", list(months))
        .agg(F.min(F.struct(*_order(), F.col(value).alias("v"))))
    )
    fill = F.lit(CELL_FILL.get(value)).cast(captures.schema[value].dataType)
    return cells.select(
        "tag",
        *[
            F.when(F.col(f"`{m}`").isNull(), fill)
            .otherwise(F.col(f"`{m}`.v"))
            .alias(f"date_{m}")
            for m in months
        ],
    )


def occasion_labels(caught: DataFrame) -> DataFrame:
    """The columns of the table: position ``t``, month, name, year, month, interval."""
    return (
        interval_vector(caught)
        .withColumnRenamed("j", "t")
        .withColumn("column", scalar.occasion_column(F.col("dateYM")))
        .withColumns(
            {
                "year": scalar.year_of_column(F.col("column")),
                "month": scalar.month_of_column(F.col("column")),
            }
        )
    )


def interval_vector(caught: DataFrame) -> DataFrame:
    """Months until the next sampling month, per column of the table.

    Every row carries the columns of the whole table, so any one row has the answer.
    """
    columns = F.arrays_zip(F.col("months").alias("m"), F.col("intervals").alias("gap"))
    one = caught.agg(F.any_value(columns).alias("columns"))
    return one.select(F.posexplode("columns").alias("p", "c")).select(
        (F.col("p") + 1).alias("j"),
        _month_text(F.col("c.m")).alias("dateYM"),
        F.col("c.gap").alias(INTERVAL),
    )


def state_proportions(caught: DataFrame) -> DataFrame:
    """Share of each state among all captured cells with a known state."""
    by_state = (
        history_cells(caught)
        .filter("state > 0")
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per state
    total = F.sum("n").over(Window.partitionBy())
    return by_state.select("state", "n", (F.col("n") / total).alias("proportion"))


def initial_proportions(caught: DataFrame, states: Sequence[int]) -> list[float]:
    """Shares of the given states in their order, a state without captures is 0.

    These are the chances of the states at first capture in the model.
    """
    share = {r["state"]: r["proportion"] for r in state_proportions(caught).collect()}
    return [share.get(s, 0.0) for s in states]


def state_trajectories(caught: DataFrame) -> DataFrame:
    """Strings of a fish's known states in month order and how often each occurs."""
    states = F.filter("cells.state", lambda s: s.isNotNull() & (s != 0))
    return (
        caught.select(F.array_join(states, "").alias("trajectory"))
        .groupBy("trajectory")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_last_frequencies(histories: DataFrame) -> DataFrame:
    """How often each pair ``first_last`` occurs."""
    pair = scalar.paste(F.col("first"), F.col("last"))
    return (
        histories.select(pair.alias("firstLast"))
        .groupBy("firstLast")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def known_state(histories: DataFrame, value: str = "enc") -> DataFrame:
    """Known-alive indicator of 0/1 histories: arrays ``known`` beside ``tag`` and ``months``.

    0 before the first encounter, 1 up to the last one, NULL after it (and throughout
    a history without encounters). The array is three runs, laid out from its first and last
    encounter; no row leaves its place.
    """
    y = F.transform(f"y_{value}", lambda v: F.coalesce(v > 0, F.lit(False)))
    seen = histories.select("tag", "months", y.alias("_y"))
    n, first = F.size("_y"), F.array_position("_y", True).cast("int")
    behind = F.array_position(F.reverse("_y"), True).cast("int") - 1
    ends = seen.select(
        "tag", "months", n.alias("n"), first.alias("_first"),
        F.when(first > 0, behind).otherwise(n).alias("_behind"),
    )
    before = F.greatest(F.col("_first") - 1, F.lit(0))
    known = F.concat(
        F.array_repeat(F.lit(0), before),
        F.array_repeat(F.lit(1), F.col("n") - F.col("_behind") - before),
        F.array_repeat(F.lit(None).cast("int"), F.col("_behind")),
    )
    return ends.select("tag", "months", known.alias("known"))


def observation_codes(histories: DataFrame, states: str = "sizeState") -> DataFrame:
    """Model input: 1 = not seen, s + 1 = seen in state s; NULL states stay NULL."""
    return histories.select(
        "tag",
        "first",
        "last",
        F.transform(f"y_{states}", lambda s: s + 1).alias("y"),
    )


def complete_histories(observed: DataFrame) -> DataFrame:
    """Histories without a missing state."""
    return observed.filter(~F.exists("y", lambda v: v.isNull()))


def incomplete_count(observed: DataFrame) -> DataFrame:
    """How many fish :func:`complete_histories` leaves out."""
    return observed.agg(
        F.count_if(F.exists("y", lambda v: v.isNull())).alias("nIncomplete"),
        F.count(F.lit(1)).alias("nFish"),
    )


def collapse_histories(observed: DataFrame) -> DataFrame:
    """Equal histories share a likelihood: one row each, with the number of fish."""
    return observed.groupBy("first", "y").agg(F.count(F.lit(1)).alias("n"))
