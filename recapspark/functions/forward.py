"""Forward recursion over a batch of encounter histories.

Plain numpy on the rows of one Arrow batch. ``y`` has one row per history: 1 = not
seen, s + 1 = seen in state s; ``first`` is the 1-based column of the first capture.
States are 0..S-1 alive and S dead. ``gamma[t]`` is the transition matrix from column t
to t + 1 and ``p[t]`` the detection probability at column t + 1.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Ship these functions with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _likelihoods(y_t, p_t):
    """P(observation | state) at one column for every history, dead state last."""
    n, s = len(y_t), len(p_t)
    out = np.zeros((n, s + 1))
    missed = y_t == 1
    out[missed, :s] = 1 - p_t
    out[missed, s] = 1.0
    seen = np.flatnonzero(~missed)
    state = y_t[seen] - 2
    out[seen, state] = p_t[state]
    return out


def forward(first, y, gamma, p, delta, keep=False):
    """Log likelihood per history; with ``keep`` also the filtered states per column.

    ``first`` must be ascending, so the histories that have started form a prefix.
    """
    n, width = y.shape
    s = len(delta)
    alpha = np.zeros((n, s + 1))
    log_lik = np.zeros(n)
    kept = np.zeros((width, n, s + 1)) if keep else None
    started = 0
    for t in range(width):
        now = int(np.searchsorted(first, t + 1, side="right"))
        if started:
            alpha[:started] = (alpha[:started] @ gamma[t - 1]) * _likelihoods(
                y[:started, t], p[t - 1]
            )
        new = np.arange(started, now)
        state = y[new, t] - 2
        alpha[new, state] = delta[state]
        started = now
        total = alpha[:started].sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            log_lik[:started] += np.log(total)
            alpha[:started] = np.where(
                total[:, None] > 0, alpha[:started] / total[:, None], 0.0
            )
        if keep:
            kept[t, :started] = alpha[:started]
    return (log_lik, kept) if keep else log_lik


def expected_counts(first, y, weight, gamma, p, delta):
    """Posterior mean transitions ``(t, from, to)``, detections and misses ``(t, state)``.

    Returns them with the weighted total log likelihood.
    """
    n, width = y.shape
    s = len(delta)
    log_lik, filtered = forward(first, y, gamma, p, delta, keep=True)
    moves = np.zeros((width - 1, s, s + 1))
    seen, missed = np.zeros((width - 1, s)), np.zeros((width - 1, s))
    ahead = np.ones((n, s + 1))
    for t in range(width - 2, -1, -1):
        k = int(np.searchsorted(first, t + 1, side="right"))
        if k == 0:
            break
        arrive = _likelihoods(y[:k, t + 1], p[t]) * ahead[:k]
        pair = filtered[t, :k, :, None] * gamma[t][None] * arrive[:, None, :]
        total = pair.sum(axis=(1, 2))
        scale = np.divide(weight[:k], total, out=np.zeros(k), where=total > 0)
        moves[t] = np.einsum("nij,n->ij", pair[:, :s, :], scale)
        state = pair.sum(axis=1) * scale[:, None]
        was_missed = y[:k, t + 1] == 1
        missed[t] = state[was_missed, :s].sum(axis=0)
        seen[t] = state[~was_missed, :s].sum(axis=0)
        back = arrive @ gamma[t].T
        ahead[:k] = back / np.maximum(back.max(axis=1, keepdims=True), 1e-300)
    return moves, seen, missed, float(np.dot(weight, log_lik))


def by_first(first, *arrays):
    """Sort by first capture; returns the order with the sorted arrays."""
    order = np.argsort(first, kind="stable")
    return (order, first[order], *[a[order] for a in arrays])


def table_of(moves, seen, missed):
    """Counts as columns ``kind, t, s_from, s_to, value`` with 1-based indices."""
    steps, s, _ = moves.shape
    t, a, b = np.indices(moves.shape)
    t2, a2 = np.indices(seen.shape)
    none = np.zeros(seen.size, dtype=np.int64)
    return {
        "kind": ["move"] * moves.size + ["seen"] * seen.size + ["missed"] * missed.size,
        "t": np.concatenate([t.ravel(), t2.ravel(), t2.ravel()]).astype(np.int32) + 1,
        "s_from": np.concatenate([a.ravel(), a2.ravel(), a2.ravel()]).astype(np.int32) + 1,
        "s_to": np.concatenate([b.ravel() + 1, none, none]).astype(np.int32),
        "value": np.concatenate([moves.ravel(), seen.ravel(), missed.ravel()]),
    }
