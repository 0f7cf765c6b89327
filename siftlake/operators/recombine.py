"""Recombination: few weighted points with the same weighted mean of test functions."""

from __future__ import annotations

import numpy as np

from siftlake.functions.linalg import cutoff


#: Points that are recombined by one table of null directions, and how many of more points are added at a time.
ALL_AT_ONCE, RUN = 1024, 256


def _null_basis(a: np.ndarray, rcond: float | None) -> np.ndarray:
    """Rows b with b @ a = 0, for n x q values a."""
    u, s, _ = np.linalg.svd(a, full_matrices=True)
    cut = cutoff(rcond, max(a.shape)) * (s[0] if len(s) else 0)
    return u.T[int((s > cut).sum()) :]


def caratheodory(values: np.ndarray, w: np.ndarray, rcond: float | None = None) -> np.ndarray:
    """Weights of a vertex of {v >= 0: sum v = sum w, v @ values = w @ values}; zeros stay zero.

    Each step moves along a null direction until a weight is zero, and takes that point out of the other directions.
    Many points are added run by run to those that are left, so no table of null directions is large.
    """
    out, own = np.zeros(len(w)), np.flatnonzero(w > 0)
    if len(own) > ALL_AT_ONCE:
        left, v, run = own[:0], w.astype(float), max(RUN, 4 * (values.shape[1] + 1))
        for lo in range(0, len(own), run):
            some = np.concatenate((left, own[lo : lo + run]))
            v[some] = _vertex(values[some], v[some], rcond)
            left = some[v[some] > 0]
        out[left] = v[left]
        return out
    return _vertex(values, w, rcond)


def _vertex(values: np.ndarray, w: np.ndarray, rcond: float | None) -> np.ndarray:
    out, own = np.zeros(len(w)), np.flatnonzero(w > 0)
    v = w[own].astype(float)
    basis = _null_basis(np.column_stack((np.ones(len(own)), values[own])), rcond)[::-1].copy()
    live = np.ones(len(own), bool)
    for i in range(len(basis)):
        b = basis[i]
        up = np.flatnonzero((b > 0) & live)
        if not len(up):
            b = -b
            up = np.flatnonzero((b > 0) & live)
            if not len(up):
                continue
        ratio = v[up] / b[up]
        at = up[int(np.argmin(ratio))]
        v = np.where(live, np.maximum(v - ratio.min() * b, 0), 0)
        v[at], live[at] = 0, False
        rest = basis[i + 1 :]
        rest -= np.outer(rest[:, at] / b[at], b)
        rest[:, at] = 0
    out[own] = v
    return out


def tree(values: np.ndarray, w: np.ndarray, factor: int = 2, rcond: float | None = None) -> np.ndarray:
    """The same by centroids of factor * (tests + 1) groups of points again and again, each round keeping few groups."""
    if factor < 2:
        raise ValueError(f"factor is {factor}; groups of points shrink from a factor of 2 on")
    out, own = np.zeros(len(w)), np.flatnonzero(w > 0)
    v = w[own].astype(float)
    groups = factor * (values.shape[1] + 1)
    while len(own) > groups:
        of = np.arange(len(own)) % groups
        mass = np.bincount(of, v, groups)
        centre = np.column_stack([np.bincount(of, v * values[own, j], groups) for j in range(values.shape[1])]) / mass[:, None]
        kept = caratheodory(centre, mass, rcond)
        scale = kept / mass
        v = v * scale[of]
        alive = v > 0
        if alive.all():
            break
        own, v = own[alive], v[alive]
    out[own] = caratheodory(values[own], v, rcond)
    return out
