"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recapspark.config import SIX_STATE_WEIGHTS
from recapspark.operators import (
    dedup, diagnostics, growth, histories, hmm, posterior, prepare, tables,
)
from recapspark.operators.storage import new_folder, stored
from recapspark.plans import flows
from recapspark.sources import files, standin
from recapspark.sources.schema import CAPTURE_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RAW_OUT = [c for c in CAPTURE_COLUMNS if c not in ("Date", "Time")] + [
    "dateC", "date", "dateTime", "dateYM", "species", "tag", "enc",
]
CLEAN_OUT = [
    "tag", "FishNum", "date", "dateYM", "dateTime", "species", "Length", "Water", "enc",
    "occ", "knownZ", "firstObserved", "lastObserved", "isFirstObserved",
    "isLastObserved", "riverN", "mainTrib", "mainTribN", "sizeState", "state",
    "dateMedianDiff", "dateMedianDiffMonth",
]
DELTA = (0.5, 0.3, 0.2)
#: Columns of the wide table: the months of the orders, any other month, and captures without a date.
WIDE_MONTHS = [
    *[f"{y}-{m:02}" for y in range(1992, 2002) for m in range(1, 13)], histories.OTHER, None,
]


def query(name: str):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def six(c: Column | str) -> Column:
    """A float to six decimals, half up, as both engines of a comparison do it."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(28,6)").cast("double")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(c) for c in columns})


def _clean(spark, sf, occasions=False, river_number=False, first_last=False):
    return flows.clean_captures(
        *standin.capture_files(spark, sf),
        occasions=occasions or first_last,
        river_number=river_number,
        first_last=first_last,
    )


def _tagged(spark, sf) -> DataFrame:
    """Captures with a tag, before any column that needs a pass over the data."""
    files_ = standin.capture_files(spark, sf)
    derived = prepare.derive_captures(prepare.union_captures(*files_))
    return prepare.classify(prepare.remove_untagged(derived))


def _kept(spark, sf, *by) -> DataFrame:
    return dedup.kept_counts(_tagged(spark, sf), *by)


def _caught(spark, sf, subset, **options) -> DataFrame:
    return flows.caught_months(*standin.capture_files(spark, sf), subset, **options)


def _rows(spark, sf, subset) -> DataFrame:
    return flows.history_rows(*standin.capture_files(spark, sf), subset)


def _model_input(spark, sf, subset="main", states="sizeState") -> DataFrame:
    return stored(flows.model_input(_caught(spark, sf, subset), states))


# --- preparation -----------------------------------------------------------------


@query("prepare_raw")
def _(spark, sf):
    d = prepare.derive_captures(
        prepare.union_captures(*standin.capture_files(spark, sf))
    )
    seconds = F.expr("extract(HOUR FROM time) * 3600 + extract(MINUTE FROM time) * 60")
    seconds = seconds + F.expr("extract(SECOND FROM time)")
    return d.select(*RAW_OUT, seconds.cast("int").alias("timeSeconds"))


@query("prepare_captures")
def _(spark, sf):
    d = flows.all_captures(*standin.capture_files(spark, sf)).select(*CLEAN_OUT)
    return rounded(d, "dateMedianDiff", "dateMedianDiffMonth")


@query("month_intervals")
def _(spark, sf):
    out = prepare.median_details(prepare.month_intervals(_tagged(spark, sf)))
    return rounded(out, "dateMedianDiff", "dateMedianDiffMonth")


@query("gt_one_capture")
def _(spark, sf):
    return dedup.gt_one_capture(_tagged(spark, sf))


@query("gt_once_per_day_tags")
def _(spark, sf):
    return dedup.gt_once_per_day_tags(_tagged(spark, sf))


@query("target_d")
def _(spark, sf):
    d = _clean(spark, sf, True, True, True).select(*CLEAN_OUT)
    return rounded(d, "dateMedianDiff", "dateMedianDiffMonth")


@query("remove_same_day")
def _(spark, sf):
    d = dedup.remove_same_day(_tagged(spark, sf))
    return d.select("tag", "FishNum", "date", "species", "Length", "Water")


#: Fields that the written capture file has wrong, by capture number, and how.
SPOILED = {"Length": (101, "12.5cm"), "SpeciesCd": (103, "brown"), "Rep": (211, "2.x")}


@query("csv_problems")
def _(spark, sf):
    """Captures written as CSV with some wrong fields and read back, problems kept."""
    first, second = standin.capture_files(spark, sf)
    path = new_folder(spark, "csv")
    for number, part in enumerate((first, second)):
        spoiled = part.select(
            *[
                F.when(F.pmod("FishNum", F.lit(SPOILED[c][0])) == 0, SPOILED[c][1])
                .otherwise(F.col(c).cast("string"))
                .alias(c)
                if c in SPOILED
                else F.col(f"`{c}`")
                for c in (part.columns if number else part.columns[::-1])
            ]
        )
        files.write_csv(spoiled, f"{path}/{number}")
    back = files.read_captures(spark, [f"{path}/0", f"{path}/1"], rescued="rescued")
    told = F.transform("rescued.problems", lambda p: F.concat_ws(" ", p["column"], p["value"], p["expected"]))
    return back.withColumnRenamed("Mark PreCd", "MarkPreCd").select(
        *CAPTURE_COLUMNS, F.coalesce(F.array_join(F.array_sort(told), ", "), F.lit("")).alias("problems")
    )


@query("model_run_store")
def _(spark, sf):
    """Draws stored as runs of two models, the latest run of one read back."""
    path = new_folder(spark, "runs")
    draws = _draws(spark, sf)
    files.save_model_run(draws.filter("chain = 1"), path, "main", "2022-07-26 09")
    files.save_model_run(draws.filter("chain = 2"), path, "trib", "2022-07-28 11")
    files.save_model_run(draws, path, "main", "2022-07-27 14")
    back = files.read_model_run(spark, path, "main")
    return rounded(back.select("chain", "iter", "value", "name", "s_from", "s_to", "t"), "value")


# --- counts and tables -----------------------------------------------------------


@query("counts_by_date")
def _(spark, sf):
    return tables.counts(_kept(spark, sf, "date"), "date", weight="n")


@query("counts_by_species")
def _(spark, sf):
    return tables.counts(_kept(spark, sf, "species"), "species", weight="n")


@query("counts_by_month")
def _(spark, sf):
    return tables.counts(_kept(spark, sf, "dateYM"), "dateYM", weight="n")


@query("n_unique_tags")
def _(spark, sf):
    return tables.n_unique_tags(_kept(spark, sf).filter("n > 0"))


PER_FISH = {
    "water": ["Water"],
    "state": ["state"],
    "maintrib_species": ["mainTrib", "species"],
    "maintrib": ["mainTrib"],
}


def _register_per_fish(suffix, by):
    @query(f"tag_counts_{suffix}")
    def _(spark, sf):
        return tables.most_first(_kept(spark, sf, *by), *by)


for _suffix, _by in PER_FISH.items():
    _register_per_fish(_suffix, _by)


def _register_count_freq(name, by):
    @query(name)
    def _(spark, sf):
        per_fish = _kept(spark, sf, *by)
        return per_fish.groupBy("n").agg(F.count(F.lit(1)).alias("freq"))


_register_count_freq("capture_count_freq", ["Water"])
_register_count_freq("capture_count_freq_state", ["state"])
_register_count_freq("capture_count_freq_maintrib", ["mainTrib", "species"])


@query("xtab_water_river")
def _(spark, sf):
    return tables.contingency(_clean(spark, sf, river_number=True), "Water", "riverN")


def _xtab_n(spark, sf, *by):
    per_fish = _kept(spark, sf, *by)
    return tables.contingency(
        per_fish.withColumnRenamed("n", "nCaptures"), "nCaptures", by[0]
    )


@query("xtab_water_n")
def _(spark, sf):
    return _xtab_n(spark, sf, "Water")


@query("xtab_state_n")
def _(spark, sf):
    return _xtab_n(spark, sf, "state")


@query("xtab_maintrib_n")
def _(spark, sf):
    return _xtab_n(spark, sf, "mainTrib", "species")


def _per_fish_species(spark, sf):
    return _kept(spark, sf, "mainTrib", "species").drop("n")


@query("counts_by_species_fish")
def _(spark, sf):
    return tables.counts(_per_fish_species(spark, sf), "species")


@query("xtab_maintrib_species")
def _(spark, sf):
    return tables.contingency(_per_fish_species(spark, sf), "mainTrib", "species")


@query("xtab_maintrib_species_wide")
def _(spark, sf):
    wide = tables.contingency_wide(_per_fish_species(spark, sf), "mainTrib", "species")
    return wide.toDF(*[c.replace(" ", "_") for c in wide.columns])


@query("length_histogram")
def _(spark, sf):
    return rounded(tables.length_histogram(_clean(spark, sf)), "binStart")


@query("locations_export")
def _(spark, sf):
    return files.locations(_clean(spark, sf))


# --- growth ----------------------------------------------------------------------


@query("growth_rows")
def _(spark, sf):
    d = growth.growth_rows(_clean(spark, sf)).select(
        "tag", "FishNum", "date", "year", "month", "Length", "LengthLag", "dateLag",
        "dateDiff", "growth",
    )
    return d


@query("growth_month")
def _(spark, sf):
    return rounded(growth.growth_by_month(_tagged(spark, sf)), "mean")


@query("growth_month_clipped")
def _(spark, sf):
    return rounded(growth.growth_by_month(_tagged(spark, sf), (-0.3, 0.4)), "mean")


@query("growth_size")
def _(spark, sf):
    return rounded(growth.growth_by_size(_tagged(spark, sf)), "mean", "sd")


@query("growth_size_year")
def _(spark, sf):
    return rounded(growth.growth_by_size_year(_tagged(spark, sf)), "mean", "sd")


@query("growth_one_year")
def _(spark, sf):
    out = growth.growth_by_size_year(_tagged(spark, sf), year=1999, more_than=20)
    return rounded(out, "mean", "sd")


@query("growth_drilldown")
def _(spark, sf):
    return growth.growth_values(_tagged(spark, sf), 2000, "main", 2)


# --- encounter histories ---------------------------------------------------------


@query("never_captured")
def _(spark, sf):
    return histories.never_captured(_clean(spark, sf))


@query("first_on_last_occ")
def _(spark, sf):
    return histories.first_on_last_occasion(_clean(spark, sf, first_last=True))


@query("first_on_last_occ_dated")
def _(spark, sf):
    d = _clean(spark, sf, first_last=True)
    return histories.first_on_last_occasion(d.filter(F.col("date").isNotNull()))


@query("gt1_obs_per_occ")
def _(spark, sf):
    return histories.gt1_obs_per_occasion(_clean(spark, sf))


@query("keep_first_obs")
def _(spark, sf):
    return histories.thin_occasions(_clean(spark, sf)).select(
        "tag", "FishNum", "dateYM", "dateTime"
    )


@query("keep_first_obs_only")
def _(spark, sf):
    return histories.thin_occasions(_clean(spark, sf), "first").select(
        "tag", "FishNum", "dateYM", "dateTime"
    )


@query("eh_data_main")
def _(spark, sf):
    rows = _rows(spark, sf, "main")
    return rows.select("tag", "FishNum", "date", "species", "sizeState").orderBy(
        "tag", F.asc_nulls_last("date"), "FishNum"
    )


def _register_long(subset):
    @query(f"eh_long_{subset}")
    def _(spark, sf):
        caught = _caught(spark, sf, subset, river_number=True, intervals=True)
        dense = histories.encounter_histories(caught)
        return rounded(histories.history_long(dense), "dateMedianDiffMonth")


for _subset in flows.SUBSETS:
    _register_long(_subset)


@query("eh_cells_main")
def _(spark, sf):
    out = histories.history_cells(_caught(spark, sf, "main", intervals=True))
    return rounded(out, "dateMedianDiffMonth")


@query("eh_wide_main")
def _(spark, sf):
    dense = histories.encounter_histories(_caught(spark, sf, "main"))
    return histories.history_wide(stored(dense), "sizeState", WIDE_MONTHS)


@query("eh_head")
def _(spark, sf):
    dense = histories.encounter_histories(_caught(spark, sf, "main"))
    top = tables.first_rows(dense.select("tag", "first", "y_enc"), ["first", "tag"], 8)
    return top.select("tag", "first", F.array_join("y_enc", ",").alias("eh"))


@query("eh_first_last_main")
def _(spark, sf):
    dense = histories.encounter_histories(_caught(spark, sf, "main"))
    return dense.select("tag", "first", "last")


@query("occasion_labels")
def _(spark, sf):
    out = histories.occasion_labels(_caught(spark, sf, "main", intervals=True))
    return rounded(out, "dateMedianDiffMonth")


@query("known_state")
def _(spark, sf):
    dense = histories.encounter_histories(_caught(spark, sf, "main"))
    known = histories.known_state(dense)
    return known.select("tag", F.posexplode("known").alias("p", "known")).select(
        "tag", (F.col("p") + 1).alias("j"), "known"
    )


@query("eh_store")
def _(spark, sf):
    """Histories of both rivers from one fold, stored by fish and read by name."""
    store = files.ResultStore(spark, new_folder(spark, "store"))
    flows.store_months(store, *standin.capture_files(spark, sf), "months")
    parts = []
    for river in ("main", "trib"):
        dense = histories.encounter_histories(flows.stored_histories(store, "months", river))
        long = histories.history_long(dense)
        parts.append(rounded(long, "dateMedianDiffMonth").withColumn("river", F.lit(river)))
    return parts[0].unionByName(parts[1])


#: Matrices of the bundle of histories, and the columns of the long table they show.
MATRICES = {
    "eh": "enc", "riverMatrix": "Water", "riverNMatrix": "riverN", "stateMatrix": "state",
    "sizeStateMatrix": "sizeState",
}


@query("eh_bundle_main")
def _(spark, sf):
    """All matrices of the bundle, a row per fish and matrix, with first and last occasion."""
    bundle = flows.history_bundle(*standin.capture_files(spark, sf), "main")
    out = None
    for name in MATRICES:
        cells = [F.col(f"`{c}`").cast("string") for c in bundle[name].columns if c != "tag"]
        row = F.array_join(F.array(*cells), ",", "NA")
        part = bundle[name].select("tag", F.lit(name).alias("matrix"), row.alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out.join(bundle["firstLast"], "tag")


@query("median_dates_given")
def _(spark, sf):
    """Month medians written as CSV, read back, and joined to the captures they came from."""
    d = _tagged(spark, sf)
    path = new_folder(spark, "medians")
    files.write_csv(prepare.month_intervals(d), path)
    joined = prepare.join_month_intervals(d, files.read_month_intervals(spark, path))
    out = joined.select("tag", "FishNum", "dateYM", "occ", "dateMedianDiff", "dateMedianDiffMonth")
    return rounded(out, "dateMedianDiff", "dateMedianDiffMonth")


@query("interval_vector")
def _(spark, sf):
    out = histories.interval_vector(_caught(spark, sf, "main", intervals=True))
    return rounded(out, "dateMedianDiffMonth")


@query("date_median")
def _(spark, sf):
    out = histories.month_medians_of(_rows(spark, sf, "main"))
    return rounded(out, "dateMedianDiffMonth")


@query("n_states")
def _(spark, sf):
    return histories.n_size_states(_rows(spark, sf, "main"))


@query("state_proportions")
def _(spark, sf):
    return rounded(histories.state_proportions(_caught(spark, sf, "all")), "proportion")


@query("state_trajectories")
def _(spark, sf):
    return histories.state_trajectories(_caught(spark, sf, "all"))


def _register_first_last(name, subset):
    @query(name)
    def _(spark, sf):
        dense = histories.encounter_histories(_caught(spark, sf, subset))
        return histories.first_last_frequencies(dense)


_register_first_last("first_last_freq", "all")
_register_first_last("first_last_freq_main", "main")
_register_first_last("first_last_freq_trib", "trib")


@query("history_counts")
def _(spark, sf):
    counted = histories.collapse_histories(flows.model_input(_caught(spark, sf, "main")))
    return counted.select("first", F.array_join("y", ",").alias("y"), "n")


@query("incomplete_histories")
def _(spark, sf):
    dense = histories.encounter_histories(_caught(spark, sf, "main"))
    return histories.incomplete_count(histories.observation_codes(dense))


# --- model -----------------------------------------------------------------------


SIX_STATES = hmm.alpha_by_move(**SIX_STATE_WEIGHTS)
SIX_STATES = SIX_STATES / SIX_STATES.sum(axis=1, keepdims=True)
#: Change of state, chances at first capture and slope of the example parameters.
EXAMPLES = {
    1: (hmm.alpha_matrix(1, 1.0), (1.0,), 0.1),
    3: (hmm.alpha_matrix(3), DELTA, 0.1),
    6: (SIX_STATES, (0.3, 0.2, 0.1, 0.2, 0.1, 0.1), 0.05),
}


def example_params(
    n_occasions: int, n_states: int = 3, p_link: str = "logit"
) -> hmm.ModelParams:
    """Parameters by formula in state and time, as the SQL side states them."""
    psi, delta, slope = EXAMPLES[n_states]
    t = np.arange(1, n_occasions)[:, None]
    s = np.arange(1, n_states + 1)[None, :]
    return hmm.ModelParams(
        phi=0.55 + slope * s + 0.01 * (t % 5),
        psi=np.broadcast_to(psi, (n_occasions - 1, n_states, n_states)),
        beta_p=slope * s + 0.05 * (t % 7),
        delta=np.array(delta),
        p_link=p_link,
    )


def _loglik(spark, sf, subset, states, n_states, p_link="logit") -> DataFrame:
    observed = _model_input(spark, sf, subset, states)
    params = example_params(hmm.n_occasions(observed), n_states, p_link)
    scored = hmm.hmm_loglik(observed, params)
    return rounded(scored.select("tag", "first", "loglik"), "loglik")


@query("hmm_loglik")
def _(spark, sf):
    return _loglik(spark, sf, "main", "sizeState", 3)


@query("hmm_loglik_trib")
def _(spark, sf):
    return _loglik(spark, sf, "trib", "sizeState", 3)


@query("hmm_loglik_alive_dead")
def _(spark, sf):
    return _loglik(spark, sf, "main", "enc", 1)


@query("hmm_loglik_alive_dead_direct")
def _(spark, sf):
    return _loglik(spark, sf, "main", "enc", 1, "identity")


@query("hmm_loglik_six_states")
def _(spark, sf):
    return _loglik(spark, sf, "all", "state", 6)


@query("hmm_loglik_total")
def _(spark, sf):
    observed = _model_input(spark, sf)
    params = example_params(hmm.n_occasions(observed))
    total = hmm.total_loglik(histories.collapse_histories(observed), params)
    return total.select(F.round("loglik", 4).alias("loglik"), "nFish")


@query("hmm_expected_counts")
def _(spark, sf):
    observed = _model_input(spark, sf)
    params = example_params(hmm.n_occasions(observed))
    counted = hmm.hmm_expected_counts(histories.collapse_histories(observed), params)
    return rounded(counted, "value")


@query("em_step")
def _(spark, sf):
    caught = stored(_caught(spark, sf, "main"), "histories")
    observed = stored(flows.model_input(caught), "observed")
    params = replace(
        example_params(hmm.n_occasions(observed)),
        delta=np.array(histories.initial_proportions(caught, flows.STATES["main"])),
    )
    counts = hmm.hmm_expected_counts(histories.collapse_histories(observed), params)
    return rounded(hmm.maximise(counts, params), "value")


@query("fit_map")
def _(spark, sf):
    observed = _model_input(spark, sf)
    fit = hmm.fit_map(observed, DELTA)
    return hmm.params_table(spark, fit.params)


# --- posterior tables ------------------------------------------------------------


def _draws(spark, sf) -> DataFrame:
    return posterior.parse_parameters(standin.raw_draws(spark, sf))


def _occasions(spark, sf) -> DataFrame:
    """Labels and intervals of each river's own months: both from one fold of the captures."""
    d = flows.all_captures(
        *standin.capture_files(spark, sf), occasions=False, river_number=False, first_last=False
    )
    rivers = {river: flows.SUBSETS[river] for river in ("main", "trib")}
    months = histories.fold_months(d, rivers, values=["enc"])
    months = stored(months.join(dedup.gt_once_per_day_tags(d), "tag", "left_anti"), "months")
    intervals = stored(prepare.month_intervals(d), "intervals")
    main, trib = (
        histories.occasion_labels(
            histories.caught_of_months(months, river, intervals=intervals)
        ).withColumn("river", F.lit(river))
        for river in rivers
    )
    return stored(main.unionByName(trib))


def _runs(spark, sf) -> DataFrame:
    """Draws of two runs: chain 1 plays the main river, chain 2 the tributaries."""
    river = F.when(F.col("chain") == 1, "main").otherwise("trib")
    return _draws(spark, sf).withColumn("river", river)


def _labelled(spark, sf, name: str) -> DataFrame:
    draws = posterior.of_parameter(_runs(spark, sf), name)
    summary = posterior.posterior_summary(draws, by=["river"])
    return posterior.label(summary, _occasions(spark, sf))


def _phi_both(spark, sf) -> DataFrame:
    occasions = _occasions(spark, sf)
    draws = posterior.of_parameter(_runs(spark, sf), "betaPhi")
    draws = posterior.add_monthly_survival(draws, occasions)
    summary = posterior.posterior_summary(draws, by=["river"])
    return posterior.phi_with_monthly(posterior.label(summary, occasions))


MEANS = ["meanPhi", "sdPhi", "meanLo", "meanMed", "meanHi"]


@query("posterior_draws")
def _(spark, sf):
    return rounded(_draws(spark, sf), "value")


@query("posterior_summary")
def _(spark, sf):
    draws = hmm.thin_draws(_draws(spark, sf), n_burnin=20, thin=5)
    return posterior.posterior_summary(draws)


@query("posterior_phi")
def _(spark, sf):
    return posterior.of_parameter(
        posterior.posterior_summary(_draws(spark, sf)), "betaPhi"
    )


@query("caterpillar")
def _(spark, sf):
    return posterior.caterpillar(_draws(spark, sf), digits=6)


@query("posterior_rhat")
def _(spark, sf):
    return rounded(posterior.rhat(_draws(spark, sf)), "rhat")


@query("posterior_neff")
def _(spark, sf):
    out = posterior.n_eff(_draws(spark, sf))
    return out.withColumn("nEff", F.round("nEff", 3))


@query("prior_overlap")
def _(spark, sf):
    draws = _draws(spark, sf)
    return rounded(
        posterior.prior_overlap(draws, posterior.prior_draws(draws)), "overlap"
    )


@query("posterior_autocovariance")
def _(spark, sf):
    found = diagnostics.autocovariance(_draws(spark, sf), 10)
    keys = [*posterior.PARAMETER, "chain", "n"]
    each = found.select(*keys, F.posexplode("covariances").alias("lag", "covariance"))
    return rounded(each, "covariance")


@query("posterior_neff_spectral")
def _(spark, sf):
    out = diagnostics.n_eff_spectral(_draws(spark, sf))
    return out.withColumn("nEff", F.round("nEff", 3))


@query("prior_density_overlap")
def _(spark, sf):
    draws = _draws(spark, sf)
    return rounded(diagnostics.density_overlap(draws, posterior.prior_draws(draws)), "overlap")


@query("posterior_labelled")
def _(spark, sf):
    runs, occasions = _runs(spark, sf), _occasions(spark, sf)
    return posterior.union_rivers(
        *[
            posterior.label(
                posterior.posterior_summary(runs.filter(F.col("river") == river)),
                occasions,
                river,
            )
            for river in ("main", "trib")
        ]
    )


@query("phi_means")
def _(spark, sf):
    return rounded(posterior.phi_means(_labelled(spark, sf, "betaPhi")), *MEANS)


@query("psi_means")
def _(spark, sf):
    return rounded(posterior.psi_means(_labelled(spark, sf, "psi")), *MEANS)


@query("phi_vs_monthly")
def _(spark, sf):
    return _phi_both(spark, sf)


@query("phi_line")
def _(spark, sf):
    return rounded(posterior.phi_line(_phi_both(spark, sf)), "slope", "intercept")


@query("phi_line_band")
def _(spark, sf):
    band = posterior.phi_line_band(_phi_both(spark, sf))
    return rounded(band, "fit", "se", "lo", "hi")


@query("phi_by_year")
def _(spark, sf):
    out = posterior.phi_by_year(_labelled(spark, sf, "betaPhi"))
    return rounded(out, "phiProd")


@query("p_by_year")
def _(spark, sf):
    return rounded(posterior.p_by_year(_labelled(spark, sf, "betaP")), "pMean")
