"""Multistate capture-recapture model over encounter histories.

S live states and death. Survival ``phi``, change of state ``psi`` and detection ``p``
vary over time and by state; the first capture is given. Parameters are small (states
squared times months) and travel with the job; histories stay distributed.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recapspark.config import DIRICHLET_OTHER, DIRICHLET_SAME
from recapspark.functions import forward as fwd
from recapspark.functions import scalar
from recapspark.operators.histories import collapse_histories
from recapspark.operators.storage import stored
from recapspark.sources.schema import DRAWS, PARAMS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of the filtered-state array that one numpy call may hold (64 MB).
_CELLS = 8_000_000
_COUNTS = "kind string, t int, s_from int, s_to int, value double"


@dataclass(frozen=True)
class ModelParams:
    """``phi[t, s]``, ``psi[t, s, s']``, ``beta_p[t, s]`` for t = 1..T-1 and ``delta[s]``."""

    phi: np.ndarray
    psi: np.ndarray
    beta_p: np.ndarray
    delta: np.ndarray
    p_link: str = "logit"

    def __post_init__(self):
        if self.p_link not in ("logit", "identity"):
            raise ValueError("p_link is 'logit' or 'identity'")
        if not np.allclose(self.psi.sum(axis=2), 1):
            raise ValueError("rows of psi must sum to 1")

    @property
    def detection(self) -> np.ndarray:
        if self.p_link == "identity":
            return self.beta_p
        return 1 / (1 + np.exp(-self.beta_p))

    @property
    def gamma(self) -> np.ndarray:
        """Transition matrices with death as the last, absorbing state."""
        steps, s = self.phi.shape
        out = np.zeros((steps, s + 1, s + 1))
        out[:, :s, :s] = self.phi[:, :, None] * self.psi
        out[:, :s, s] = 1 - self.phi
        out[:, s, s] = 1.0
        return out

    def arrays(self):
        return self.gamma, self.detection, np.asarray(self.delta, dtype=float)

    def rows(self, draw: int = 0) -> list[tuple]:
        """Long form, see ``PARAMS``."""
        steps, s = self.phi.shape
        out = []
        for t in range(steps):
            for a in range(s):
                out.append((draw, "betaPhi", a + 1, None, t + 1, float(self.phi[t, a])))
                out.append((draw, "betaP", a + 1, None, t + 1, float(self.beta_p[t, a])))
                for b in range(s):
                    out.append(
                        (draw, "psi", a + 1, b + 1, t + 1, float(self.psi[t, a, b]))
                    )
        return out


def alpha_matrix(
    n_states: int = 3, same: float = DIRICHLET_SAME, other: float = DIRICHLET_OTHER
) -> np.ndarray:
    """Dirichlet weights of the state changes: one value on, one off the diagonal."""
    return np.where(np.eye(n_states) == 1, same, other)


def alpha_by_move(
    same: float, shrink: float, grow1: float, grow2: float, move: float
) -> np.ndarray:
    """Dirichlet weights for river x size states (1-3 main, 4-6 tributaries).

    Getting smaller has the weight ``shrink``, also on the way to the other river. Any
    other change of river is a ``move``; within a river a fish keeps its size or grows
    by one or two classes.
    """
    river, size = np.divmod(np.arange(6), 3)
    gain = size[None, :] - size[:, None]
    stays = river[:, None] == river[None, :]
    within = np.select([gain == 0, gain == 1], [same, grow1], grow2)
    return np.where(gain < 0, shrink, np.where(stays, within, move))


def params_table(spark: SparkSession, params: ModelParams, draw: int = 0) -> DataFrame:
    return spark.createDataFrame(params.rows(draw), PARAMS)


def n_occasions(observed: DataFrame) -> int:
    """Width of the history table."""
    row = observed.select(F.size("y").alias("T")).first()
    if row is None:
        raise ValueError("no histories")
    return row["T"]


def _matrix(lists: pa.Array) -> np.ndarray:
    """List column with rows of equal length as a matrix."""
    if not len(lists):
        return np.empty((0, 1), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.int64)


def hmm_loglik(observed: DataFrame, params: ModelParams) -> DataFrame:
    """Add ``loglik``, the log likelihood of each history (columns ``first``, ``y``).

    Works on fish or on collapsed histories; no shuffle.
    """
    gamma, p, delta = params.arrays()

    def batch_loglik(first: pa.Array, y: pa.Array) -> pa.Array:
        if not len(first):
            return pa.array([], pa.float64())
        order, f, rows = fwd.by_first(
            first.to_numpy(zero_copy_only=False).astype(np.int64), _matrix(y)
        )
        out = np.empty(len(order))
        out[order] = fwd.forward(f, rows, gamma, p, delta)
        return pa.array(out, pa.float64())

    loglik = F.arrow_udf(batch_loglik, "double")
    return observed.withColumn("loglik", loglik("first", "y"))


def total_loglik(collapsed: DataFrame, params: ModelParams) -> DataFrame:
    """Log likelihood of all fish from collapsed histories with their counts."""
    return hmm_loglik(collapsed, params).agg(
        F.sum(F.col("n") * F.col("loglik")).alias("loglik"), F.sum("n").alias("nFish")
    )


def hmm_expected_counts(collapsed: DataFrame, params: ModelParams) -> DataFrame:
    """Expected transitions, detections and misses summed over all fish.

    Rows ``(kind, t, s_from, s_to, value)``; kind ``loglik`` carries the total log
    likelihood. Every task adds its histories up first, so the shuffle moves one small
    table per task.
    """
    gamma, p, delta = params.arrays()
    n_states = len(delta)

    def count(batches):
        total = None
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False).astype(np.int64)
            y = _matrix(batch.column("y"))
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            if len(first) == 0:
                continue
            _, first, y, n = fwd.by_first(first, y, n)
            size = max(1, _CELLS // (y.shape[1] * (n_states + 1)))
            for i in range(0, len(first), size):
                part = slice(i, i + size)
                new = fwd.expected_counts(first[part], y[part], n[part], gamma, p, delta)
                total = new if total is None else [a + b for a, b in zip(total, new)]
        if total is not None:
            *tables, loglik = total
            out = fwd.table_of(*tables)
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(out["kind"] + ["loglik"]),
                    "t": pa.array(np.append(out["t"], 0), pa.int32()),
                    "s_from": pa.array(np.append(out["s_from"], 0), pa.int32()),
                    "s_to": pa.array(np.append(out["s_to"], 0), pa.int32()),
                    "value": pa.array(np.append(out["value"], loglik), pa.float64()),
                }
            )

    return (
        collapsed.select("first", "y", "n")
        .mapInArrow(count, _COUNTS)
        .groupBy("kind", "t", "s_from", "s_to")
        .agg(F.sum("value").alias("value"))
    )


#: Bounds of detection whose parameter lies in (0, 1), by link.
DETECTION = {"logit": (0.5, 1 / (1 + math.exp(-1))), "identity": (0.0, 1.0)}


def maximise(counts: DataFrame, params: ModelParams, alpha: np.ndarray | None = None) -> DataFrame:
    """The parameters that fit expected counts best, and the log posterior of those before.

    Everything has a closed form: survival is the share of fish at risk that stayed alive,
    detection the share that was seen (within what its parameter can reach), changes of state
    are the moves with the Dirichlet weights ``alpha`` added. A parameter without any fish
    stays as it was. ``counts`` comes from :func:`hmm_expected_counts`; it is folded to one row per
    time and state and unfolded into the rows of the parameters, so a step is one job.

    Returns rows like ``ModelParams.rows`` and one of ``logPosterior`` (at time 0).
    """
    s = len(params.delta)
    alpha = alpha_matrix(s) if alpha is None else np.asarray(alpha, float)
    spark = counts.sparkSession
    before = [
        (t + 1, a + 1, float(params.phi[t, a]), float(params.beta_p[t, a]))
        for t, a in np.ndindex(*params.phi.shape)
    ]
    before.append((0, 0, None, None))
    # as many rows as there are parameters
    before = spark.createDataFrame(before, "t int, s_from int, oldPhi double, oldP double")

    def of(kind, value="value"):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0.0))

    alive = F.when((F.col("kind") == "move") & (F.col("s_to") <= s), F.struct("s_to", "value"))
    folded = counts.groupBy("t", "s_from").agg(
        F.map_from_entries(F.collect_list(alive)).alias("moves"),
        of("move").alias("risk"),
        of("seen").alias("seen"),
        of("missed").alias("missed"),
        of("loglik").alias("loglik"),
    )
    d = before.join(F.broadcast(folded), ["t", "s_from"], "left")
    weights = F.array(*[F.array(*map(F.lit, row)) for row in alpha.tolist()])
    own = F.get(weights, F.col("s_from") - 1)
    states = F.sequence(F.lit(1), F.lit(s))
    moved = F.transform(states, lambda to: F.coalesce(F.try_element_at("moves", to), F.lit(0.0)))
    d = d.withColumn("_moved", moved)
    stayed = F.aggregate("_moved", F.lit(0.0), lambda x, y: x + y)
    d = d.withColumn("_weighted", F.zip_with("_moved", own, lambda x, y: x + y))
    total = F.aggregate("_weighted", F.lit(0.0), lambda x, y: x + y)
    tries = F.col("seen") + F.col("missed")
    low, high = (F.lit(x) for x in DETECTION[params.p_link])
    p = F.least(F.greatest(F.col("seen") / F.nullif(tries, F.lit(0.0)), low), high)
    beta = scalar.logit(p) if params.p_link == "logit" else p
    prior = float((alpha * np.log(params.psi)).sum())

    def row(name, value, to=F.lit(None)):
        return F.struct(
            F.lit(name).alias("name"), to.cast("int").alias("s_to"), value.alias("value")
        )

    phi = F.coalesce(stayed / F.nullif(F.col("risk"), F.lit(0.0)), F.col("oldPhi"))
    rows = F.concat(
        F.array(
            row("betaPhi", phi),
            row("betaP", F.when(tries > 0, beta).otherwise(F.col("oldP"))),
        ),
        F.zip_with(states, "_weighted", lambda to, w: row("psi", w / total, to)),
    )
    last = F.array(row("logPosterior", F.coalesce("loglik", F.lit(0.0)) + prior))
    return d.select(
        "t", "s_from", F.explode(F.when(F.col("t") > 0, rows).otherwise(last)).alias("r")
    ).select("r.name", "s_from", "r.s_to", "t", "r.value")


def params_of(rows, like: ModelParams) -> ModelParams:
    """Parameters from rows such as :func:`maximise` gives, one per parameter."""
    phi, beta_p, psi = like.phi.copy(), like.beta_p.copy(), np.array(like.psi)
    for r in rows:
        t, a = r["t"] - 1, r["s_from"] - 1
        if r["name"] == "betaPhi":
            phi[t, a] = r["value"]
        elif r["name"] == "betaP":
            beta_p[t, a] = r["value"]
        elif r["name"] == "psi":
            psi[t, a, r["s_to"] - 1] = r["value"]
    return replace(like, phi=phi, beta_p=beta_p, psi=psi)


#: Histories per task of a fit: enough to be worth a task, few enough for its memory.
_TASK_ROWS = (64, 20_000)


def _spread(df: DataFrame, rows: int, least: int, most: int, *keys: str) -> DataFrame:
    """A task per core, but no task with fewer than ``least`` or more than ``most`` rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, math.ceil(rows / least)), math.ceil(rows / most), 1)
    return df.repartition(tasks, *keys)


def reusable_histories(observed: DataFrame) -> DataFrame:
    """Collapsed histories, cut from their lineage and cached for an iterative fit."""
    collapsed = stored(collapse_histories(observed))
    return _spread(collapsed, collapsed.count(), *_TASK_ROWS, "first", "y").persist()


@dataclass(frozen=True)
class MapFit:
    params: ModelParams
    log_posterior: list[float]
    converged: bool

    @property
    def iterations(self) -> int:
        return len(self.log_posterior)


def start_params(
    n_occasions: int, delta: np.ndarray, alpha: np.ndarray, p_link: str = "logit"
) -> ModelParams:
    """A neutral starting point: even survival and detection, prior mean for changes."""
    steps, s = n_occasions - 1, len(delta)
    psi = np.broadcast_to(alpha / alpha.sum(axis=1, keepdims=True), (steps, s, s)).copy()
    half = np.full((steps, s), 0.5)
    return ModelParams(half, psi, half.copy(), np.asarray(delta, float), p_link)


def fit_map(
    observed: DataFrame,
    delta,
    alpha: np.ndarray | None = None,
    max_iter: int | None = None,
    tol: float = 1e-6,
    p_link: str = "logit",
) -> MapFit:
    """Posterior mode by EM: uniform survival and detection, Dirichlet(alpha + 1) changes.

    One job per iteration, expectation and maximum; only the parameters come back to the driver. It runs until
    the log posterior, which EM never lowers, grows by less than ``tol`` of its size.
    ``max_iter`` is for trials: a fit that it ends has ``converged`` False. A log posterior
    that isn't finite is an error.
    """
    delta = np.asarray(delta, float)
    s = len(delta)
    alpha = alpha_matrix(s) if alpha is None else alpha
    data = reusable_histories(observed)
    try:
        width = n_occasions(data)
        params = start_params(width, delta, alpha, p_link)
        trace: list[float] = []
        converged = False
        while max_iter is None or len(trace) < max_iter:
            rows = maximise(hmm_expected_counts(data, params), params, alpha).collect()
            trace.append(next(r["value"] for r in rows if r["name"] == "logPosterior"))
            if not math.isfinite(trace[-1]):
                raise ValueError("the histories are impossible under the model")
            if len(trace) > 1 and trace[-1] - trace[-2] < tol * abs(trace[-2]):
                converged = True
                break
            params = params_of(rows, params)
    finally:
        data.unpersist()
    return MapFit(params, trace, converged)


# --- draws -----------------------------------------------------------------------


def is_kept(iteration, n_burnin: int, thin: int):
    """Burn-in and thinning rule, for a number or a column."""
    return (iteration > n_burnin) & ((iteration - n_burnin) % thin == 0)


def thin_draws(draws: DataFrame, n_burnin: int, thin: int) -> DataFrame:
    """Drop the burn-in and keep every ``thin``-th draw after it."""
    return draws.filter(is_kept(F.col("iter"), n_burnin, thin))
