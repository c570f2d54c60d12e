"""The analyses end to end, each a chain of DataFrame steps.

``captures -> clean captures -> histories -> model -> posterior tables``. A cluster run
writes the clean captures and the histories once (``sources.files.write_table``) and
starts later steps from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapspark.operators import dedup, histories, hmm, prepare
from recapspark.operators.storage import stored
from recapspark.sources import files

#: Dynamic filter (columns, operators, values) of each part of the river system.
SUBSETS = {
    "all": ((), (), ()),
    "main": (("mainTrib",), ("%in%",), (["main"],)),
    "trib": (("mainTrib",), ("%in%",), (["trib"],)),
}
#: States of a model and the column that has them: size classes of one river, or both rivers'.
STATES = {"all": (1, 2, 3, 4, 5, 6), "main": (1, 2, 3), "trib": (4, 5, 6)}
STATE_COLUMN = {"all": "state", "main": "sizeState", "trib": "sizeState"}


def clean_captures(first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """Both capture files to clean captures without same-day doubles."""
    derived = prepare.derive_captures(prepare.union_captures(first, second))
    return prepare.prepare_captures(derived, drop_same_day=True, **options)


def all_captures(first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """Both capture files to clean captures, same-day doubles included."""
    derived = prepare.derive_captures(prepare.union_captures(first, second))
    return prepare.prepare_captures(derived, **options)


def caught_months(
    first: DataFrame,
    second: DataFrame,
    subset: str = "all",
    river_number: bool = False,
    intervals: bool = False,
) -> DataFrame:
    """Capture files to the sparse histories of one part of the river system.

    Fish with same-day doubles leave after the captures are folded to months, which
    saves the join of that removal with every capture row. River numbers and intervals
    are worked out only on request.
    """
    d = all_captures(
        first, second, occasions=False, river_number=river_number, first_last=False
    )
    return histories.caught_months(
        d,
        *SUBSETS[subset],
        drop=dedup.gt_once_per_day_tags(d),
        intervals=prepare.month_intervals(d) if intervals else None,
    )


def store_months(store: files.ResultStore, first: DataFrame, second: DataFrame, name: str) -> None:
    """Fold capture files to (fish, month) and store the fold under ``name``, bucketed by fish.

    Fish with same-day doubles are gone from it. Sampling months go to ``<name>_intervals``. The fold
    is bounded by the calendar for any fish, so no bucket is heavy through one of them.
    """
    d = all_captures(first, second, occasions=False, first_last=False)
    months = histories.fold_months(d, SUBSETS)
    gone = dedup.gt_once_per_day_tags(d)
    store.save(months.join(gone, "tag", "left_anti"), name, by="tag")
    store.save(prepare.month_intervals(d), f"{name}_intervals")


def stored_histories(store: files.ResultStore, name: str, subset: str = "all") -> DataFrame:
    """Sparse histories of one part of the river system from a stored fold, without a shuffle."""
    intervals = store.read(f"{name}_intervals")
    return histories.caught_of_months(store.read(name), subset, intervals=intervals)


def history_rows(first: DataFrame, second: DataFrame, subset: str = "all") -> DataFrame:
    """Capture files to the capture rows behind the histories, with their intervals."""
    d = all_captures(first, second, river_number=False, first_last=False)
    same_day = dedup.same_day_facts(d)
    return histories.history_rows(d, *SUBSETS[subset], same_day=same_day)


def history_bundle(
    first: DataFrame, second: DataFrame, subset: str = "all"
) -> dict[str, DataFrame]:
    """Everything about the histories of one part of the river system, by name.

    Stores the histories once, sparse and dense; the tables start from there. ``eh`` and the matrices of
    river, river number, state and size state are wide, one row per fish.
    """
    caught = stored(caught_months(first, second, subset, True, True))
    dense = stored(histories.encounter_histories(caught), "histories")
    rows = history_rows(first, second, subset)
    wide = {
        "eh": "enc",
        "riverMatrix": "Water",
        "riverNMatrix": "riverN",
        "stateMatrix": "state",
        "sizeStateMatrix": "sizeState",
    }
    return {
        **{k: histories.history_wide(dense, v) for k, v in wide.items()},
        "dateMedianDiffMonthVector": histories.interval_vector(caught),
        "tags": dense.select("tag"),
        "firstLast": dense.select("tag", "first", "last"),
        "dateMedian": histories.month_medians_of(rows),
        "data": rows.orderBy("tag", F.asc_nulls_last("date"), "FishNum"),
    }


def model_input(caught: DataFrame, states: str = "sizeState") -> DataFrame:
    """Complete observation histories by size class (``enc`` for alive/dead only)."""
    dense = histories.encounter_histories(caught)
    return histories.complete_histories(histories.observation_codes(dense, states))


def fit(
    first: DataFrame,
    second: DataFrame,
    subset: str,
    path: str,
    alpha=None,
    run_id: str | None = None,
    **options,
) -> tuple[str, hmm.MapFit]:
    """Capture files to a stored model run: histories, chances at first capture, mode, run.

    The chances of the states at first capture are the shares of the captured states. The run is
    stored as one draw of one chain under the model's name, ``map_<subset>``, so tables of posterior
    draws read it as they read others. ``options`` go to ``hmm.fit_map``. Returns the
    run id and the fit.
    """
    caught = stored(caught_months(first, second, subset), "histories")
    delta = histories.initial_proportions(caught, STATES[subset])
    observed = model_input(caught, STATE_COLUMN[subset])
    found = hmm.fit_map(observed, delta, alpha, **options)
    draws = hmm.params_table(caught.sparkSession, found.params, draw=1).select(
        F.lit(1).alias("chain"), F.col("draw").alias("iter"), "name", "s_from", "s_to", "t", "value"
    )
    return files.save_model_run(draws, path, f"map_{subset}", run_id), found
