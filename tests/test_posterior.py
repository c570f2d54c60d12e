import numpy as np
import pytest
from pyspark.sql import functions as F

from recapspark.functions import scalar
from recapspark.functions.quantiles import grouped_quantiles
from recapspark.operators import skew
from recapspark.operators import posterior, tables
from recapspark.sources import standin

from conftest import SMALL

SCHEMA = "chain int, iter int, name string, s_from int, s_to int, t int, value double"


def draws(spark, values, chains=2):
    rows = [(1 + i % chains, i // chains, "betaPhi", 1, None, 1, float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_parse_parameters(spark):
    df = spark.createDataFrame(
        [("betaPhi[1, 3]",), ("psi[1, 2, 5]",), ("betaPhiMonthly[2,4]",)], "parameter string")
    got = [tuple(r) for r in posterior.parse_parameters(df).collect()]
    assert got == [("betaPhi", 1, None, 3), ("psi", 1, 2, 5), ("betaPhiMonthly", 2, None, 4)]


def test_prefix_does_not_match(spark):
    df = spark.createDataFrame([("betaPhi",), ("betaPhiMonthly",)], "name string")
    assert posterior.of_parameter(df, "betaPhi").count() == 1


def test_summary_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=999)
    r = posterior.posterior_summary(draws(spark, x), digits=None).first()
    want = [x.mean(), x.std(ddof=1), *np.quantile(x, [0.025, 0.5, 0.975])]
    assert [r["mean"], r["sd"], r["lo"], r["med"], r["hi"]] == pytest.approx(want)


def test_quantiles_of_any_group(spark):
    """A group with most of the rows, ties, extreme values and infinities, against numpy."""
    rng = np.random.default_rng(1)
    groups = {
        "hot": np.concatenate([rng.normal(size=700), np.full(500, 0.25), [1e12, -1e9]]),
        "same": np.full(300, 3.5),
        "small": rng.uniform(size=9),
        "ends": np.concatenate([np.arange(50.0), [np.inf]]),
        "wide": np.concatenate([[-1.5e308, 1.5e308], np.arange(50.0)]),
        None: rng.integers(0, 4, size=400).astype(float),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = grouped_quantiles(df, ["g"], "v", probs).collect()
    assert len(got) == len(groups)
    for r in got:
        values = np.sort(groups[r["g"]])
        want = [values[int(p * (len(values) - 1))] if p in (0.0, 1.0) else None for p in probs]
        middle = np.quantile(values, probs[1:4]) if np.isfinite(values).all() else None
        assert r["quantiles"][0] == want[0] and r["quantiles"][-1] == want[-1]
        if middle is not None:
            assert r["quantiles"][1:4] == pytest.approx(middle, rel=1e-9)
        else:
            assert r["quantiles"][1:4] == pytest.approx([1.25, 25.0, 45.0])


def test_many_equally_heavy_keys(spark):
    rows = spark.range(40_000).select((F.col("id") % 2000).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    joined = skew.attach_facts(rows, facts, ["k"], ["low"], "n", ["id"], min_rows=5)
    assert joined.count() == 40_000 and joined.filter("low <> k").count() == 0


def test_rounding_is_half_up(spark):
    r = posterior.posterior_summary(draws(spark, [0.0125] * 4)).first()
    assert r["med"] == 0.013


def test_rhat_and_neff(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    both = draws(spark, x)
    a, b = x[0::2], x[1::2]
    within = (a.var(ddof=1) + b.var(ddof=1)) / 2
    n = 2000
    total = (n - 1) / n * within + np.var([a.mean(), b.mean()], ddof=1)
    assert posterior.rhat(both).first()["rhat"] == pytest.approx((total / within) ** 0.5)
    means = [c.reshape(20, 100).mean(axis=1) for c in (a, b)]
    want = 4000 * x.var() / (100 * np.concatenate(means).var(ddof=1))
    assert posterior.n_eff(both).first()["nEff"] == pytest.approx(want)


def test_prior_overlap(spark):
    x = np.random.default_rng(3).normal(scale=10**0.5, size=20000)
    d = draws(spark, x)
    prior = posterior.prior_draws(d)
    stats = prior.agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).first()
    assert stats["m"] == pytest.approx(0, abs=0.1) and stats["s"] == pytest.approx(10**0.5, rel=0.05)
    assert posterior.prior_overlap(d, prior).first()["overlap"] > 0.9
    far = d.withColumn("value", F.col("value") / 1000 + 9)
    assert posterior.prior_overlap(far, prior).first()["overlap"] < 0.1


def test_contingency_has_empty_cells(spark):
    df = spark.createDataFrame(
        [("x", 1), ("x", 1), ("y", 2), (None, 3), ("z", None)], "a string, b int")
    got = {tuple(r) for r in tables.contingency(df, "a", "b").collect()}
    assert got == {("x", 1, 2), ("x", 2, 0), ("y", 1, 0), ("y", 2, 1)}
    wide = tables.contingency_wide(df, "a", "b")
    assert {tuple(r) for r in wide.collect()} == {("x", 2, 0), ("y", 0, 1)}


def test_histogram_of_equal_lengths(spark):
    df = spark.createDataFrame([("main", "brown trout", 5.0)] * 3,
                               "mainTrib string, species string, Length double")
    assert [tuple(r) for r in tables.length_histogram(df).collect()] == [("main", 0, 5.0, 3)]


def test_standin_draws_cover_all_parameters(spark):
    d = posterior.parse_parameters(standin.raw_draws(spark, SMALL))
    per = d.groupBy(*posterior.PARAMETER, "chain").count()
    assert per.count() == 30
    assert d.count() == d.select(*posterior.PARAMETER, "chain", "iter").distinct().count()


def test_student_quantiles(spark):
    df = spark.range(1, 1200).select("id", scalar.student_quantile(F.col("id")).alias("q"))
    got = {r["id"]: r["q"] for r in df.collect()}
    for n, want in {1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 10: 2.2281388520, 30: 2.0422724563,
                    120: 1.9799304050, 1000: 1.9623390808}.items():
        assert got[n] == pytest.approx(want, abs=2e-9)
    values = [got[n] for n in sorted(got)]
    assert values == sorted(values, reverse=True)
    assert spark.range(1).select(scalar.student_quantile(F.lit(0))).first()[0] is None


def test_contingency_of_very_many_levels(spark):
    for rows, columns in (("a", "b"), ("b", "a")):
        many = spark.range(60_000).select(F.col("id").alias("a"), F.pmod("id", F.lit(3)).alias("b"))
        got = tables.contingency(many, rows, columns)
        assert got.count() == 180_000 and got.agg(F.sum("n")).first()[0] == 60_000
        assert got.filter("n = 0").count() == 120_000
