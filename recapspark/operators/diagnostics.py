"""How well chains of posterior draws mix, and how much a posterior owes to its prior."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapspark.functions.quantiles import clean_values
from recapspark.operators.posterior import PARAMETER

#: Consecutive draws of a chain that one group of lagged products holds.
_STRETCH = 4096
#: Cells per bandwidth of a density, and how many bandwidths a kernel reaches.
_FINE, _REACH = 4, 4


def _with_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with the facts of their keys, one row each; NULL keys meet.

    Spark broadcasts the facts only if they are found to be small.
    """
    named = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(named, same).drop(*[f"_{k}" for k in keys])


def autocovariance(draws: DataFrame, lags: int, step: int = 1) -> DataFrame:
    """``n``, ``mean`` and ``covariances``, lags 0 to ``lags``, per parameter and chain.

    A covariance is the sum of the products of draws that lie ``lag`` steps of ``step`` iterations
    apart, over all ``n`` draws. Draws without a value are left out. A chain with missing or repeated
    iterations has NULL ``covariances``.

    A chain is cut into stretches that overlap by ``lags`` draws, so no task holds a chain.
    """
    keys = [*PARAMETER, "chain"]
    draws = clean_values(draws.select(*keys, "iter", "value"), "value")
    facts = draws.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.min("iter").alias("_from"),
        F.max("iter").alias("_upto"),
    )
    stretch = max(_STRETCH, lags)
    place = F.floor((F.col("iter") - F.col("_from")) / step)
    own, into = F.floor(F.col("_place") / stretch), F.pmod("_place", F.lit(stretch))
    before = (into < lags) & (own > 0)
    d = (
        _with_facts(draws, facts, keys)
        .withColumn("_place", place)
        .withColumn("_off", F.col("value") - F.col("mean"))
        .withColumn("_own", own)
        .withColumn("_stretch", F.explode(F.when(before, F.array(own, own - 1)).otherwise(F.array(own))))
    )
    order = Window.partitionBy(*keys, "_stretch").orderBy("iter")
    head = F.col("_own") == F.col("_stretch")
    # the window's results become columns before they are multiplied: one window for all lags
    ahead = {f"_x{k}": F.lead("_off", k).over(order) for k in range(1, lags + 1)}
    d = d.withColumns({**ahead, "_gap": F.lead("_place", 1).over(order) - F.col("_place")})
    d = d.withColumn("_x0", F.col("_off"))
    sums = d.groupBy(*keys, "n", "mean", "_from", "_upto").agg(
        F.min("_gap").alias("_least"),
        *[
            F.coalesce(F.sum(F.when(head, F.col("_off") * F.col(f"_x{k}"))), F.lit(0.0)).alias(f"_s{k}")
            for k in range(lags + 1)
        ],
    )
    whole = (F.col("_upto") - F.col("_from")) == (F.col("n") - 1) * step
    single = F.coalesce(F.col("_least") > 0, F.lit(True))
    covariances = F.array(*[F.col(f"_s{k}") / F.col("n") for k in range(lags + 1)])
    return sums.select(
        *keys, "n", "mean", F.when(whole & single, covariances).alias("covariances")
    )


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def spectrum_at_zero(covariances: Column, n: Column, limit: Column) -> Column:
    """Spectral density at frequency zero of a chain, from an autoregression.

    Levinson-Durbin recursion over the covariances; of the orders 0 to ``limit`` that with the
    least Akaike criterion counts, the lower one on ties. NULL for a constant chain.
    """
    variance = F.get(covariances, F.lit(0))

    def fit(a, v, p):
        loss = n * F.log(v) + 2.0 * p
        return F.struct(loss.alias("loss"), a.alias("a"), v.alias("v"), p.alias("p"))

    def longer(state, p):
        a, v = state["now"]["a"], state["now"]["v"]
        back = F.reverse(F.slice(covariances, F.lit(2), p - 1))
        explained = _sum(F.zip_with(a, back, lambda x, y: x * y))
        partial = F.try_divide(F.get(covariances, p) - explained, v)

        def step(k):
            new = F.concat(F.zip_with(a, F.reverse(a), lambda x, y: x - k * y), F.array(k))
            return fit(new, v * (1.0 - k * k), p)

        def choose(new):
            better = new["loss"] < state["best"]["loss"]
            best = F.when(better, new).otherwise(state["best"])
            return F.struct(new.alias("now"), best.alias("best"))

        return _let(_let(partial, step), choose)

    none = fit(F.expr("CAST(array() AS array<double>)"), variance, F.lit(0))
    orders = F.when(limit > 0, F.sequence(F.lit(1), limit)).otherwise(F.expr("CAST(array() AS array<int>)"))
    start = F.struct(none.alias("now"), none.alias("best"))

    def density(best):
        noise = best["v"] * n / (n - best["p"] - 1)
        rest = 1.0 - _sum(best["a"])
        return F.try_divide(noise, rest * rest)

    found = F.aggregate(orders, start, longer, lambda s: s["best"])
    return F.when(variance > 0, _let(found, density))


def n_eff_spectral(draws: DataFrame, step: int = 1) -> DataFrame:
    """Effective sample size per parameter from the spectra of its chains at zero.

    A chain of n draws counts as n times its variance over its spectral density at zero, and
    chains add up. Autoregressions have at most 10 log10(n) terms. NULL if a chain is constant, has one draw, or
    misses or repeats iterations.
    """
    counts = clean_values(draws, "value").groupBy(*PARAMETER, "chain").agg(F.count(F.lit(1)).alias("n"))
    # one number: the draws of the longest chain
    longest = counts.agg(F.max("n")).first()[0] or 1
    lags = max(1, math.floor(10 * math.log10(longest)))
    chains = autocovariance(draws, lags, step)
    n = F.col("n")
    most = F.least(F.floor(10 * F.log10(n)), n - 2, F.lit(lags)).cast("int")
    spectrum = spectrum_at_zero(F.col("covariances"), n, most)
    variance = F.try_divide(F.get("covariances", F.lit(0)) * n, n - 1)
    chains = chains.withColumn("_eff", F.try_divide(n * variance, spectrum))
    return chains.groupBy(*PARAMETER).agg(
        F.when(F.count("_eff") == F.count(F.lit(1)), F.sum("_eff")).alias("nEff")
    )


def _bandwidth(values: DataFrame, *keys: str) -> DataFrame:
    """Normal-reference bandwidth ``h`` and number of values ``n`` of each group."""
    h = 1.06 * F.col("sd") * F.pow("n", F.lit(-0.2))
    return (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"))
        .select(*keys, "n", F.when(F.col("sd") > 0, h).alias("h"))
    )


def _density(values: DataFrame, *keys: str) -> DataFrame:
    """Normal kernel density at the points ``at * h / 4``, where it isn't next to nothing.

    Values are counted in cells around the points before a kernel spreads them. The number of
    cells grows with the fifth root of the values.
    """
    cell = F.round(F.col("value") / F.col("h") * _FINE).cast("long")
    cells = values.groupBy(*keys, "n", "h", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    reach = _FINE * _REACH
    away = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    z = F.col("away") / _FINE
    kernel = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    share = F.col("c") / (F.col("n") * F.col("h"))
    spread = cells.withColumn("away", away).withColumn("_part", share * kernel)
    at = F.col("cell") + F.col("away")
    return spread.groupBy(*keys, "h", at.alias("at")).agg(F.sum("_part").alias("density"))


def density_overlap(draws: DataFrame, prior: DataFrame) -> DataFrame:
    """Area below both the prior's density and that of each parameter's posterior.

    Both are normal kernel densities with bandwidth 1.06 sd n^(-1/5); the prior's is read off
    by linear interpolation at the points of the posterior's. Rows without a value are left out.
    ``overlap`` is NULL for a parameter whose draws are all equal or fewer than two, and for all if the prior is such.
    """
    draws = clean_values(draws.select(*PARAMETER, "value"), "value")
    prior = clean_values(prior.select("value"), "value").withColumn("_all", F.lit(1))
    widths = _bandwidth(draws, *PARAMETER)
    usable = widths.filter(F.col("h").isNotNull())
    post = _density(_with_facts(draws, usable, PARAMETER), *PARAMETER)
    around = _density(_with_facts(prior, _bandwidth(prior, "_all").filter("h IS NOT NULL"), ["_all"]), "_all")
    # the density at both ends of every stretch between two points
    ends = around.select(
        F.col("h").alias("_h"),
        F.explode(
            F.array(
                F.struct(F.col("at").alias("_cell"), F.col("density").alias("l"), F.lit(0.0).alias("r")),
                F.struct((F.col("at") - 1).alias("_cell"), F.lit(0.0).alias("l"), F.col("density").alias("r")),
            )
        ).alias("e"),
    )
    ends = ends.groupBy("_h", "e._cell").agg(F.sum("e.l").alias("_l"), F.sum("e.r").alias("_r"))
    # one row: the prior's bandwidth, NULL if it has none
    width = _bandwidth(prior, "_all").agg(F.max("h")).scalar()
    x = F.col("at") * F.col("h") / _FINE
    d = post.withColumn("_x", x / width * _FINE).withColumn("_floor", F.floor("_x"))
    d = d.join(ends, F.col("_floor") == F.col("_cell"), "left")
    into = F.col("_x") - F.col("_floor")
    below = F.coalesce(F.col("_l") * (1 - into) + F.col("_r") * into, F.lit(0.0))
    area = F.sum(F.least(F.col("density"), below) * F.col("h") / _FINE)
    found = d.groupBy(*PARAMETER).agg(F.when(F.max("_x").isNotNull(), area).alias("overlap"))
    empty = widths.filter(F.col("h").isNull()).select(*PARAMETER, F.lit(None).cast("double").alias("overlap"))
    return found.unionByName(empty)
