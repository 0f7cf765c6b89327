"""Weights for chosen points: small dense systems, of kernel means that are computed on all points."""

from __future__ import annotations

import numpy as np

EPSILON = 1e-10


def sbq(gram: np.ndarray, mean: np.ndarray, epsilon: float = EPSILON) -> np.ndarray:
    """Sequential Bayesian quadrature: gram w = mean; weights may be negative and need not sum to 1."""
    return np.linalg.solve(gram + epsilon * np.eye(len(gram)), mean)


def simplex(gram: np.ndarray, mean: np.ndarray, epsilon: float = EPSILON, rounds: int = 10_000) -> np.ndarray:
    """Minimises w' gram w / 2 - mean' w over w >= 0, sum w = 1, by an active set.

    On the free points the minimum under the sum is a linear system; a step that would make a weight negative stops
    there and fixes it at 0, and a fixed weight with the most negative multiplier becomes free again.
    """
    n = len(mean)
    k = gram + epsilon * np.eye(n)
    w, free = np.full(n, 1 / n), np.ones(n, bool)
    for _ in range(rounds):
        f = np.flatnonzero(free)
        system = np.block([[k[np.ix_(f, f)], np.ones((len(f), 1))], [np.ones((1, len(f))), np.zeros((1, 1))]])
        got = np.linalg.lstsq(system, np.append(mean[f], 1.0), rcond=None)[0]
        step = got[:-1] - w[f]
        down = step < -1e-15
        ratio = np.where(down, w[f] / np.where(down, -step, 1), np.inf)
        if ratio.min() < 1:
            at = int(np.argmin(ratio))
            w[f] = np.maximum(w[f] + ratio[at] * step, 0)
            w[f[at]], free[f[at]] = 0.0, False
            continue
        w[f] = got[:-1]
        gap = k @ w - mean + got[-1]
        gap[free] = 0
        at = int(np.argmin(gap))
        if gap[at] >= -1e-12:
            break
        free[at] = True
    w = np.maximum(w, 0)
    return w / w.sum()
