import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from conftest import SMALL

from recapspark.config import SIX_STATE_WEIGHTS
from recapspark.functions import forward as fwd
from recapspark.operators import histories, hmm
from recapspark.plans import flows
from recapspark.sources import files, standin

DELTA = [0.5, 0.3, 0.2]


def constant(width, p_link="logit"):
    """The time-constant parameters of the published golden values."""
    steps = width - 1
    return hmm.ModelParams(
        np.tile([0.8, 0.7, 0.6], (steps, 1)),
        np.broadcast_to(hmm.alpha_matrix(3), (steps, 3, 3)),
        np.tile([0.5, 0.25, 0.75], (steps, 1)),
        np.array(DELTA),
        p_link,
    )


def random_params(width, seed=0, s=3):
    rng = np.random.default_rng(seed)
    psi = np.stack([[rng.dirichlet(a) for a in hmm.alpha_matrix(s)] for _ in range(width - 1)])
    phi, beta = rng.uniform(size=(width - 1, s)), rng.uniform(size=(width - 1, s))
    return hmm.ModelParams(phi, psi, beta, np.full(s, 1 / s))


def count_tables(rows, steps, s=3):
    """Expected counts as arrays and the log likelihood."""
    moves, seen, missed = np.zeros((steps, s, s + 1)), np.zeros((steps, s)), np.zeros((steps, s))
    loglik = 0.0
    for r in rows:
        if r["kind"] == "loglik":
            loglik = r["value"]
        elif r["kind"] == "move":
            moves[r["t"] - 1, r["s_from"] - 1, r["s_to"] - 1] = r["value"]
        else:
            (seen if r["kind"] == "seen" else missed)[r["t"] - 1, r["s_from"] - 1] = r["value"]
    return moves, seen, missed, loglik


def observed(spark, histories):
    rows = [(f"f{i}", f, list(y)) for i, (f, y) in enumerate(histories)]
    return spark.createDataFrame(rows, "tag string, first int, y array<int>")


def brute_force(first, y, params):
    """Probability of a history by enumerating all state paths."""
    gamma, p, delta = params.arrays()
    s = len(delta)
    start, total = y[first - 1] - 2, 0.0
    for path in itertools.product(range(s + 1), repeat=len(y) - first):
        z, prob, now = [start, *path], delta[start], first
        for a, b in zip(z, z[1:]):
            prob *= gamma[now - 1][a, b]
            if b == s:
                prob *= y[now] == 1
            else:
                prob *= 1 - p[now - 1][b] if y[now] == 1 else p[now - 1][b] * (y[now] == b + 2)
            now += 1
        total += prob
    return total


@pytest.mark.parametrize("states,loglik", [
    ([1, 0, 2], -4.4759222686), ([2, 0, 0], -1.9537558033),
    ([3, 3, 0, 0], -3.3845313659), ([1], -0.6931471806)])
def test_golden_likelihoods(spark, states, loglik):
    df = observed(spark, [(1, [s + 1 for s in states])])
    got = hmm.hmm_loglik(df, constant(len(states))).first()["loglik"]
    assert got == pytest.approx(loglik, abs=1e-9)


@pytest.mark.parametrize("s", [2, 3])
def test_all_histories_sum_to_one_and_match_enumeration(spark, s):
    width, first = 4, 2
    params = random_params(width, seed=s, s=s)
    ys = [
        [1, a, *rest]
        for a in range(2, s + 2)
        for rest in itertools.product(range(1, s + 2), repeat=width - first)
    ]
    got = hmm.hmm_loglik(observed(spark, [(first, y) for y in ys]), params).collect()
    probs = {tuple(r["y"]): math.exp(r["loglik"]) for r in got}
    assert sum(probs.values()) == pytest.approx(1)
    for y, p in probs.items():
        assert p == pytest.approx(brute_force(first, y, params), abs=1e-12)


def test_six_states(spark):
    alpha = hmm.alpha_by_move(**SIX_STATE_WEIGHTS)
    assert alpha[0] == pytest.approx([0.75, 0.025, 0.001, 0.025, 0.025, 0.025])
    assert alpha[4] == pytest.approx([0.01, 0.025, 0.025, 0.01, 0.75, 0.025])
    assert alpha[2] == pytest.approx([0.01, 0.01, 0.75, 0.01, 0.01, 0.025])
    params = hmm.start_params(3, np.full(6, 1 / 6), alpha)
    y = [7, 1, 4]
    got = hmm.hmm_loglik(observed(spark, [(1, y)]), params).first()["loglik"]
    assert math.exp(got) == pytest.approx(brute_force(1, y, params))


def test_alive_or_dead_only(spark):
    """One live state: survival and detection alone."""
    data = observed(spark, [(1, (2, 1, 2, 1)), (1, (2, 2, 1, 1)), (2, (1, 2, 2, 2))] * 20)
    fit = hmm.fit_map(data, [1.0], hmm.alpha_matrix(1, 1.0), max_iter=5)
    assert fit.params.psi == pytest.approx(1)
    assert 0 < fit.params.phi[0, 0] <= 1 and (np.diff(fit.log_posterior) > -1e-9).all()


def test_identity_link_and_bad_params():
    assert constant(3, "identity").detection[0, 0] == 0.5
    with pytest.raises(ValueError):
        constant(3, "probit")
    with pytest.raises(ValueError):
        hmm.ModelParams(np.ones((1, 1)), np.full((1, 1, 1), 0.9), np.ones((1, 1)), np.ones(1))


def test_params_long_form(spark):
    rows = hmm.params_table(spark, constant(3)).collect()
    assert len(rows) == 2 * (3 + 3 + 9)
    psi = [r["value"] for r in rows if r["name"] == "psi" and r["t"] == 1 and r["s_from"] == 2]
    assert psi == [0.1, 0.8, 0.1]


HISTORIES = [(1, (2, 1, 3, 1)), (1, (2, 1, 1, 1)), (2, (1, 4, 4, 1)), (3, (1, 1, 3, 2)),
             (4, (1, 1, 1, 2)), (1, (3, 3, 1, 4))]


def collapsed(spark, weights):
    rows = [(f, list(y), int(w)) for (f, y), w in zip(HISTORIES, weights)]
    return spark.createDataFrame(rows, "first int, y array<int>, n long")


def exact_counts(params, weights):
    """Expected moves and detections by enumeration."""
    gamma, p, delta = params.arrays()
    s, width = len(delta), 4
    moves, seen, missed = np.zeros((width - 1, s, s + 1)), np.zeros((3, s)), np.zeros((3, s))
    for (first, y), w in zip(HISTORIES, weights):
        whole = brute_force(first, y, params)
        start = y[first - 1] - 2
        for path in itertools.product(range(s + 1), repeat=width - first):
            z, prob = [start, *path], delta[start]
            for k, (a, b) in enumerate(zip(z, z[1:])):
                t = first - 1 + k
                prob *= gamma[t][a, b]
                if b == s:
                    prob *= y[t + 1] == 1
                else:
                    prob *= 1 - p[t][b] if y[t + 1] == 1 else p[t][b] * (y[t + 1] == b + 2)
            for k, (a, b) in enumerate(zip(z, z[1:])):
                t = first - 1 + k
                if a < s:
                    moves[t, a, b] += w * prob / whole
                if b < s:
                    (missed if y[t + 1] == 1 else seen)[t, b] += w * prob / whole
    return moves, seen, missed


def test_expected_counts_match_enumeration(spark):
    params, weights = random_params(4, seed=5), [3, 10, 1, 2, 4, 1]
    rows = hmm.hmm_expected_counts(collapsed(spark, weights), params).collect()
    got = count_tables(rows, 3)
    for a, b in zip(got, exact_counts(params, weights)):
        assert a == pytest.approx(b)
    total = hmm.total_loglik(collapsed(spark, weights), params).first()
    assert got[3] == pytest.approx(total["loglik"]) and total["nFish"] == 21


@pytest.mark.parametrize("p_link", ["logit", "identity"])
def test_maximum_has_the_closed_form(spark, p_link):
    params = replace(random_params(4, seed=8), p_link=p_link)
    alpha = hmm.alpha_matrix(3, 0.7, 0.4)
    counts = hmm.hmm_expected_counts(collapsed(spark, [3, 10, 1, 2, 4, 1]), params)
    moves, seen, missed, loglik = count_tables(counts.collect(), 3)
    rows = hmm.maximise(counts, params, alpha).collect()
    got = hmm.params_of(rows, params)
    alive, risk = moves[:, :, :3].sum(axis=2), moves.sum(axis=2)
    phi = np.where(risk > 0, alive / np.where(risk > 0, risk, 1), params.phi)
    psi = moves[:, :, :3] + alpha
    psi /= psi.sum(axis=2, keepdims=True)
    tries = seen + missed
    p = np.where(tries > 0, seen / np.where(tries > 0, tries, 1), params.detection)
    low, high = hmm.DETECTION[p_link]
    p = np.where(tries > 0, np.clip(p, low, high), p)
    assert got.phi == pytest.approx(phi) and got.psi == pytest.approx(psi)
    assert got.detection == pytest.approx(p)
    (value,) = [r["value"] for r in rows if r["name"] == "logPosterior"]
    assert value == pytest.approx(loglik + (alpha * np.log(params.psi)).sum())
    assert len(rows) == 3 * 3 * 5 + 1


def test_maximum_without_fish_keeps_the_parameters(spark):
    params = random_params(4, seed=9)
    none = hmm.hmm_expected_counts(collapsed(spark, [1] * 6), params).limit(0)
    got = hmm.params_of(hmm.maximise(none, params).collect(), params)
    assert got.phi == pytest.approx(params.phi) and got.beta_p == pytest.approx(params.beta_p)
    alpha = hmm.alpha_matrix(3)
    assert got.psi == pytest.approx(np.broadcast_to(alpha / alpha.sum(axis=1, keepdims=True), got.psi.shape))


def simulate(n, width, params, seed=3):
    rng = np.random.default_rng(seed)
    gamma, p, delta = params.arrays()
    s, out = len(delta), []
    for _ in range(n):
        first = int(rng.integers(1, width))
        z = rng.choice(s, p=delta)
        y = [1] * (first - 1) + [z + 2]
        for t in range(first - 1, width - 1):
            z = rng.choice(s + 1, p=gamma[t][z])
            y.append(z + 2 if z < s and rng.uniform() < p[t][z] else 1)
        out.append((first, y))
    return out


@pytest.fixture(scope="module")
def simulated(spark):
    width = 5
    params = hmm.ModelParams(
        np.tile([0.9, 0.8, 0.7], (width - 1, 1)),
        np.broadcast_to(hmm.alpha_matrix(3), (width - 1, 3, 3)),
        np.full((width - 1, 3), 0.5),
        np.array(DELTA),
    )
    return params, observed(spark, simulate(3000, width, params)).persist()


def test_em_climbs_and_recovers(simulated):
    truth, data = simulated
    fit = hmm.fit_map(data, DELTA, max_iter=25, tol=0)
    gains = np.diff(fit.log_posterior)
    assert (gains > -1e-6).all()
    assert fit.params.psi.sum(axis=2) == pytest.approx(1)
    low, high = 0.5, 1 / (1 + math.exp(-1))
    assert ((fit.params.detection >= low - 1e-9) & (fit.params.detection <= high + 1e-9)).all()
    # in the last interval only the product of survival and detection is identified
    assert fit.params.phi[:3] == pytest.approx(truth.phi[:3], abs=0.15)


def test_captures_to_a_stored_run(spark, tmp_path):
    first, second = standin.capture_files(spark, SMALL)
    for subset in ("main", "all"):
        run, fit = flows.fit(first, second, subset, str(tmp_path), run_id="2022-07-27 14", max_iter=3)
        caught = flows.caught_months(first, second, subset)
        shares = histories.initial_proportions(caught, flows.STATES[subset])
        assert list(fit.params.delta) == pytest.approx(shares) and sum(shares) == pytest.approx(1)
        draws = files.read_model_run(spark, str(tmp_path), f"map_{subset}", run).collect()
        assert hmm.params_of(draws, fit.params).psi == pytest.approx(fit.params.psi)
        s, steps = len(shares), len(fit.params.phi)
        assert len(draws) == steps * s * (s + 2) and {(r["chain"], r["iter"]) for r in draws} == {(1, 1)}
        assert fit.log_posterior == sorted(fit.log_posterior) and not fit.converged


def test_burn_in_and_thinning():
    kept = [i for i in range(1, 5001) if hmm.is_kept(i, 2000, 5)]
    assert len(kept) == 600 and kept[0] == 2005 and kept[-1] == 5000
