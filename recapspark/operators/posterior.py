"""Tables of posterior draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.config import PRIOR_PRECISION
from recapspark.functions import scalar
from recapspark.functions.quantiles import clean_values, grouped_quantiles
from recapspark.operators.storage import stored

PARAMETER = ["name", "s_from", "s_to", "t"]
_NAME = r"^([A-Za-z]\w*)\[(\d+), ?(\d+)(?:, ?(\d+))?\]$"


def parse_parameters(draws: DataFrame, column: str = "parameter") -> DataFrame:
    """Split ``betaPhi[1, 3]`` and ``psi[1, 2, 5]`` into name, states and time."""

    def part(i):
        return F.nullif(F.regexp_extract(column, _NAME, i), F.lit(""))

    third = part(4).cast("int")
    return draws.select(
        *[c for c in draws.columns if c != column],
        part(1).alias("name"),
        part(2).cast("int").alias("s_from"),
        F.when(third.isNotNull(), part(3).cast("int")).alias("s_to"),
        F.coalesce(third, part(3).cast("int")).alias("t"),
    )


def of_parameter(df: DataFrame, name: str) -> DataFrame:
    """Rows of one parameter, by its exact name."""
    return df.filter(F.col("name") == name)


def add_monthly_survival(
    draws: DataFrame, months: DataFrame, per_month: bool = False
) -> DataFrame:
    """Append ``betaPhiMonthly`` draws made of ``betaPhi`` and the interval lengths.

    ``months`` has one row per interval: ``t`` and ``dateMedianDiffMonth``, and ``river``
    if rivers have months of their own and ``draws`` has that column.
    """
    on = [c for c in ("river", "t") if c in months.columns]
    monthly = of_parameter(draws, "betaPhi").join(F.broadcast(months), on)
    monthly = monthly.withColumns(
        {
            "name": F.lit("betaPhiMonthly"),
            "value": scalar.monthly_survival(
                F.col("value"), F.col("dateMedianDiffMonth"), per_month
            ),
        }
    )
    return draws.unionByName(monthly.select(*draws.columns))


def _rounded(c: Column, digits: int | None) -> Column:
    if digits is None:
        return c
    # through decimal, so that half-way cases round up as written
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def summarise(
    draws: DataFrame,
    probs: Sequence[float],
    names: Sequence[str],
    digits: int | None = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean, sd and named quantiles per parameter, chains pooled.

    ``by`` are further keys, e.g. the river of the run.
    """
    keys = [*by, *PARAMETER]
    draws = clean_values(draws, "value")
    moments = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    quantiles = grouped_quantiles(draws, keys, "value", probs)
    # both sides have one row per parameter
    right = quantiles.select(*[F.col(k).alias(f"_{k}") for k in keys], "quantiles")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = draws.groupBy(*keys).agg(*moments).join(right, same)
    return out.select(
        *keys,
        _rounded(F.col("mean"), digits).alias("mean"),
        _rounded(F.col("sd"), digits).alias("sd"),
        *[
            _rounded(F.col("quantiles")[i], digits).alias(n)
            for i, n in enumerate(names)
        ],
    )


def posterior_summary(
    draws: DataFrame,
    digits: int | None = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean, sd, median and 95 % interval per parameter."""
    return summarise(draws, (0.025, 0.5, 0.975), ("lo", "med", "hi"), digits, by)


def caterpillar(draws: DataFrame, digits: int | None = None) -> DataFrame:
    """Median with 50 % and 95 % intervals per parameter."""
    table = summarise(
        draws,
        (0.025, 0.25, 0.5, 0.75, 0.975),
        ("lo95", "lo50", "med", "hi50", "hi95"),
        digits,
    )
    return table.drop("mean", "sd")


def rhat(draws: DataFrame) -> DataFrame:
    """Gelman-Rubin ratio per parameter, without correction for degrees of freedom."""
    chains = draws.groupBy(*PARAMETER, "chain").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("m"),
        F.var_samp("value").alias("v"),
    )
    pooled = chains.groupBy(*PARAMETER).agg(
        F.avg("n").alias("n"),
        F.avg("v").alias("within"),
        F.var_samp("m").alias("between"),
    )
    n, within = F.col("n"), F.col("within")
    total = (n - 1) / n * within + F.col("between")
    return pooled.select(*PARAMETER, F.sqrt(F.try_divide(total, within)).alias("rhat"))


def n_eff(draws: DataFrame, batches: int = 20) -> DataFrame:
    """Effective sample size per parameter by batch means.

    A batch is one of ``batches`` equal stretches of iterations of a chain.
    """
    first = draws.agg(F.min("iter")).scalar()
    last = draws.agg(F.max("iter")).scalar()
    d = draws.withColumns({"_first": first, "_span": last - first + 1})
    batch = F.floor((F.col("iter") - F.col("_first")) * batches / F.col("_span"))
    means = d.groupBy(*PARAMETER, "chain", batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("m"),
        F.var_pop("value").alias("v"),
    )
    n = F.col("n")
    pooled = means.groupBy(*PARAMETER).agg(
        F.sum("n").alias("total"),
        F.avg("n").alias("size"),
        F.var_samp("m").alias("between"),
        (F.sum(n * (F.col("v") + F.col("m") * F.col("m"))) / F.sum("n")).alias("square"),
        (F.sum(n * F.col("m")) / F.sum("n")).alias("mean"),
    )
    variance = F.col("square") - F.col("mean") * F.col("mean")
    ratio = F.try_divide(variance, F.col("size") * F.col("between"))
    return pooled.select(*PARAMETER, (F.col("total") * ratio).alias("nEff"))


def prior_draws(draws: DataFrame, precision: float = PRIOR_PRECISION) -> DataFrame:
    """One normal prior draw (mean 0) per chain and iteration of ``draws``.

    The normal numbers follow from chain and iteration (Box-Muller over two
    congruential uniforms), so a recomputed task repeats them.
    """
    k = F.col("iter").cast("long") * 2 + F.col("chain")
    u1 = ((k * 7919) % 104729 + 0.5) / 104729
    u2 = ((k * 104723) % 15485863 + 0.5) / 15485863
    z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    return (
        draws.select("chain", "iter")
        .distinct()
        .select((z / math.sqrt(precision)).alias("value"))
    )


def prior_overlap(draws: DataFrame, prior: DataFrame, width: float = 0.1) -> DataFrame:
    """Share of the posterior that the prior covers, per parameter.

    Both are counted in bins of ``width``, as many as the values need; the overlap is the
    sum over bins of the smaller share.
    """

    def binned(df, *keys):
        at = F.floor(F.col("value") / width).cast("long")
        return df.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    prior_bins = binned(prior).select(F.col("bin").alias("_bin"), F.col("n").alias("_prior"))
    n_prior = prior.agg(F.count(F.lit(1)).alias("_all_prior"))
    post = binned(draws, *PARAMETER)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*PARAMETER))
    post = post.select(*PARAMETER, "bin", share.alias("_post"))
    both = post.join(prior_bins, F.col("bin") == F.col("_bin"), "left")
    # one row: the number of prior draws
    both = both.withColumn("_share", F.coalesce("_prior", F.lit(0)) / n_prior.scalar())
    smaller = F.least(F.col("_post"), F.col("_share"))
    return both.groupBy(*PARAMETER).agg(F.sum(smaller).alias("overlap"))


def label(
    summary: DataFrame, occasions: DataFrame, river: str | None = None
) -> DataFrame:
    """Attach month and year by the position of the subset's own months, and the river.

    ``river`` may be left out if the summary already has that column. ``occasions`` with
    a column ``river`` label each river with its own months.
    """
    if river is not None:
        summary = summary.withColumn("river", F.lit(river))
    on = [c for c in ("river", "t") if c in occasions.columns]
    labels = occasions.select(*on, "dateYM", "year", "month")
    return summary.join(F.broadcast(labels), on, "left")


def union_rivers(*tables: DataFrame) -> DataFrame:
    """Stack the estimates of several rivers."""
    out, *rest = tables
    for t in rest:
        out = out.unionByName(t)
    return out


def _means(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy("river", *keys).agg(
        F.avg("mean").alias("meanPhi"),
        F.stddev_samp("mean").alias("sdPhi"),
        F.avg("lo").alias("meanLo"),
        F.avg("med").alias("meanMed"),
        F.avg("hi").alias("meanHi"),
    )


def phi_means(labelled: DataFrame) -> DataFrame:
    """Survival averaged over occasions, per river and state."""
    return _means(of_parameter(labelled, "betaPhi"), "s_from")


def psi_means(labelled: DataFrame) -> DataFrame:
    """Change of state averaged over occasions, per river and pair of states."""
    return _means(of_parameter(labelled, "psi"), "s_from", "s_to")


def phi_with_monthly(labelled: DataFrame) -> DataFrame:
    """Survival next to monthly survival of the same state and time (suffix ``_1``)."""
    keys = ["river", "s_from", "t"]
    values = ["mean", "sd", "lo", "med", "hi"]
    phi = of_parameter(labelled, "betaPhi").select(
        *keys, "dateYM", "year", "month", *values
    )
    monthly = of_parameter(labelled, "betaPhiMonthly").select(
        *keys, *[F.col(v).alias(f"{v}_1") for v in values]
    )
    return phi.join(monthly, keys)


def phi_line(both: DataFrame) -> DataFrame:
    """Least-squares line of monthly survival on survival, per state."""
    return both.groupBy("s_from").agg(
        F.regr_slope("med_1", "med").alias("slope"),
        F.regr_intercept("med_1", "med").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def phi_line_band(both: DataFrame, level: float = 0.95) -> DataFrame:
    """The line of :func:`phi_line` at every observed survival, with its confidence band.

    The band is that of the fitted mean: the standard error of the line follows from sums per
    state, one row each, times Student's quantile with two degrees of freedom less than points.
    A state with fewer than three points has a line but no band.
    """
    known = both.filter(F.col("med").isNotNull() & F.col("med_1").isNotNull())
    sums = known.groupBy("s_from").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("med").alias("_x"),
        F.avg("med_1").alias("_y"),
        F.regr_sxx("med_1", "med").alias("_sxx"),
        F.regr_sxy("med_1", "med").alias("_sxy"),
        F.regr_syy("med_1", "med").alias("_syy"),
    )
    sums = stored(
        sums.withColumns(
            {
                "_slope": F.try_divide("_sxy", "_sxx"),
                "_t": scalar.student_quantile(F.col("_n") - 2, level),
            }
        ),
        "sums",
    )
    rest = F.greatest(F.col("_syy") - F.col("_slope") * F.col("_sxy"), F.lit(0.0))
    away = F.col("med") - F.col("_x")
    spread = 1 / F.col("_n") + F.try_divide(away * away, F.col("_sxx"))
    fit = F.col("_y") + F.col("_slope") * away
    error = F.when(F.col("_n") > 2, F.sqrt(F.try_divide(rest, F.col("_n") - 2) * spread))
    # one row per state
    return known.join(F.broadcast(sums), "s_from").select(
        "river",
        "s_from",
        "t",
        F.col("med").alias("x"),
        fit.alias("fit"),
        error.alias("se"),
        (fit - F.col("_t") * error).alias("lo"),
        (fit + F.col("_t") * error).alias("hi"),
    )


def phi_by_year(labelled: DataFrame) -> DataFrame:
    """Survival over the occasions of a year, its last occasion left out."""
    phi = of_parameter(labelled, "betaPhi")
    last = F.max("t").over(Window.partitionBy("river", "s_from", "year"))
    return (
        phi.withColumn("_last", last)
        .filter(F.col("t") < F.col("_last"))
        .groupBy("river", "s_from", "year")
        .agg(
            F.product("mean").alias("phiProd"),
            F.min("dateYM").alias("firstDate"),
            F.max("dateYM").alias("lastDate"),
        )
    )


def p_by_year(labelled: DataFrame) -> DataFrame:
    """Mean detection over the occasions of a year."""
    return (
        of_parameter(labelled, "betaP")
        .groupBy("river", "s_from", "year")
        .agg(
            F.avg("mean").alias("pMean"),
            F.min("dateYM").alias("firstDate"),
            F.max("dateYM").alias("lastDate"),
        )
    )
