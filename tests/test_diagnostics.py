import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recapspark.operators import diagnostics
from recapspark.operators.posterior import PARAMETER

SCHEMA = "chain int, iter int, name string, s_from int, s_to int, t int, value double"


def chains(spark, *values, name="betaPhi", step=1):
    rows = [
        (c + 1, 7 + i * step, name, 1, None, 1, None if v is None else float(v))
        for c, chain in enumerate(values)
        for i, v in enumerate(chain)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_covariances(x, lags):
    x = np.asarray(x) - np.mean(x)
    n = len(x)
    return [float(x[: n - k] @ x[k:]) / n if k < n else 0.0 for k in range(lags + 1)]


def plain_size(x):
    """Toeplitz systems solved order by order, in place of the recursion."""
    n = len(x)
    most = min(math.floor(10 * math.log10(n)), n - 2)
    r = np.array(plain_covariances(x, max(most, 1)))
    best = (n * math.log(r[0]), 0, r[0], np.zeros(0))
    for p in range(1, most + 1):
        system = r[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
        a = np.linalg.solve(system, r[1 : p + 1])
        v = r[0] - a @ r[1 : p + 1]
        best = min(best, (n * math.log(v) + 2 * p, p, v, a), key=lambda b: b[:2])
    _, p, v, a = best
    return n * (r[0] * n / (n - 1)) / (v * n / (n - p - 1) / (1 - a.sum()) ** 2)


def ar1(rng, n, a):
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = a * x[i - 1] + rng.normal()
    return x + 3


def test_covariances_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "_STRETCH", 16)
    rng = np.random.default_rng(5)
    x, y = ar1(rng, 333, 0.6), ar1(rng, 5, 0.1)
    for step in (1, 5):
        got = {
            r["chain"]: r
            for r in diagnostics.autocovariance(chains(spark, x, y, step=step), 9, step).collect()
        }
        for chain, values in ((1, x), (2, y)):
            assert got[chain]["n"] == len(values)
            assert got[chain]["mean"] == pytest.approx(values.mean())
            assert got[chain]["covariances"] == pytest.approx(plain_covariances(values, 9), abs=1e-12)


def test_more_lags_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "_STRETCH", 4)
    x = ar1(np.random.default_rng(6), 50, 0.5)
    row = diagnostics.autocovariance(chains(spark, x), 12).first()
    assert row["covariances"] == pytest.approx(plain_covariances(x, 12))


def test_broken_chains(spark):
    whole = chains(spark, range(20))
    for broken in (
        whole.filter("iter <> 12"),
        whole.union(whole.filter("iter = 12")),
        whole.filter("iter <> 12").union(whole.filter("iter = 20")),
        whole.withColumn("value", F.when(F.col("iter") != 12, F.col("value"))),
    ):
        assert diagnostics.autocovariance(broken, 3).first()["covariances"] is None
        assert diagnostics.n_eff_spectral(broken).first()["nEff"] is None
    # draws without a value at the end only shorten a chain
    assert diagnostics.autocovariance(whole.filter("iter < 20"), 3).first()["n"] == 13
    assert diagnostics.n_eff_spectral(whole.filter("false")).count() == 0
    assert diagnostics.autocovariance(whole.filter("false"), 3).count() == 0


def test_effective_size(spark):
    rng = np.random.default_rng(7)
    long, short, sticky = ar1(rng, 3000, 0.5), rng.normal(size=40), ar1(rng, 1000, 0.95)
    both = chains(spark, long, short).union(chains(spark, sticky, name="betaP"))
    got = {r["name"]: r["nEff"] for r in diagnostics.n_eff_spectral(both).collect()}
    assert got["betaPhi"] == pytest.approx(plain_size(long) + plain_size(short))
    assert got["betaP"] == pytest.approx(plain_size(sticky))
    # an AR(1) chain of coefficient a is worth n (1 - a) / (1 + a) draws
    many = ar1(rng, 20_000, 0.5)
    size = diagnostics.n_eff_spectral(chains(spark, many)).first()["nEff"]
    assert size == pytest.approx(20_000 / 3, rel=0.1)


def test_effective_size_of_odd_chains(spark):
    odd = chains(spark, [4.0] * 30).union(chains(spark, [1.0], name="one"))
    odd = odd.union(chains(spark, [1.0, 3.0], name="two"))
    got = {r["name"]: r["nEff"] for r in diagnostics.n_eff_spectral(odd).collect()}
    assert got["betaPhi"] is None and got["one"] is None
    assert got["two"] == pytest.approx(2.0)


def normal_overlap(m1, s1, m2, s2):
    x = np.linspace(-60, 60, 400_001)
    one, two = (np.exp(-((x - m) / s) ** 2 / 2) / s / math.sqrt(2 * math.pi) for m, s in ((m1, s1), (m2, s2)))
    return float(np.minimum(one, two).sum() * (x[1] - x[0]))


def test_overlap_of_normal_densities(spark):
    rng = np.random.default_rng(8)
    prior = spark.createDataFrame([(float(v),) for v in rng.normal(0, 3, 20_000)], "value double")
    shapes = {"same": (0, 3), "narrow": (1, 0.5), "beside": (4, 1), "far": (40, 1), "thin": (0.3, 0.01)}
    draws = None
    for name, (m, s) in shapes.items():
        part = chains(spark, rng.normal(m, s, 10_000), name=name)
        draws = part if draws is None else draws.union(part)
    got = {r["name"]: r["overlap"] for r in diagnostics.density_overlap(draws, prior).collect()}
    for name, (m, s) in shapes.items():
        assert got[name] == pytest.approx(normal_overlap(m, s, 0, 3), abs=0.02), name


def plain_overlap(x, prior):
    """Every kernel at every point of a fine grid."""

    def density(at, values):
        h = 1.06 * values.std(ddof=1) * len(values) ** -0.2
        z = (at[:, None] - values[None, :]) / h
        return np.exp(-z * z / 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))

    at = np.linspace(x.min() - 5 * x.std(), x.max() + 5 * x.std(), 4001)
    return float(np.minimum(density(at, x), density(at, prior)).sum() * (at[1] - at[0]))


def test_overlap_against_every_kernel(spark):
    rng = np.random.default_rng(9)
    prior = rng.normal(0, 3, 400)
    x = np.concatenate([rng.normal(-2, 0.4, 150), rng.normal(3, 1, 90)])
    table = spark.createDataFrame([(float(v),) for v in prior], "value double")
    got = diagnostics.density_overlap(chains(spark, x), table).first()["overlap"]
    assert got == pytest.approx(plain_overlap(x, prior), abs=0.005)


def test_overlap_of_odd_values(spark):
    prior = spark.createDataFrame([(float(v),) for v in range(-5, 6)] + [(None,)], "value double")
    odd = chains(spark, [1.0, 1.0, 1.0], name="constant").union(chains(spark, [2.0], name="one"))
    odd = odd.union(chains(spark, [0.0, 1.0, None, 2.0], name="fine"))
    got = {r["name"]: r["overlap"] for r in diagnostics.density_overlap(odd, prior).collect()}
    assert got["constant"] is None and got["one"] is None and 0 < got["fine"] < 1
    assert diagnostics.density_overlap(odd.filter("false"), prior).count() == 0
    none = diagnostics.density_overlap(odd, prior.filter("false"))
    assert none.filter("overlap IS NOT NULL").count() == 0 and none.count() == 3
    assert none.columns == [*PARAMETER, "overlap"]
