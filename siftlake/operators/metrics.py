"""Discrepancies between two sets of points; kernel means run on Spark, what is left are numbers."""

from __future__ import annotations

import math

import numpy as np

from siftlake.functions.kernels import Kernel
from siftlake.functions.linalg import cholesky_solve, conjugate_gradients, nearby
from siftlake.operators import pairwise
from siftlake.operators.greedy import KdeLog
from siftlake.sources.points import LOCAL_BYTES, Points


def _root(value: float) -> float:
    return math.sqrt(max(value, 0.0))


def _mean(a: Points, b: Points, kernel: Kernel) -> float:
    return pairwise.mean(a, b, kernel).first()[0]


def mmd(reference: Points, other: Points, kernel: Kernel) -> float:
    """Maximum mean discrepancy, weighted."""
    return _root(_mean(reference, reference, kernel) + _mean(other, other, kernel) - 2 * _mean(reference, other, kernel))


class PairKernel(Kernel):
    """k(x, x') * l(y, y') on vectors that hold x and then y."""

    def __init__(self, feature: Kernel, response: Kernel, d: int):
        self.feature, self.response, self.d = feature, response, d

    def __call__(self, a, b):
        return self.feature(a[:, : self.d], b[:, : self.d]) * self.response(a[:, self.d :], b[:, self.d :])


def jmmd(reference: Points, other: Points, feature: Kernel, response: Kernel, d: int) -> float:
    """Joint discrepancy of features (d coordinates) and responses."""
    return mmd(reference.joined(), other.joined(), PairKernel(feature, response, d))


def ksd(reference: Points, other: Points, stein: Kernel, laplace=None, entropic: bool = False) -> float:
    """Kernel Stein discrepancy of `other`; laplace: rows -> sums of positive second derivatives of the log density.

    The extra terms are evaluated on the executors; the entropic one broadcasts the reference, whose size is checked.
    """
    value = _mean(other, other, stein)
    if laplace is not None:
        extra = pairwise.evaluated(other, laplace, 1)[:, 0]
        value += extra.sum() / len(extra) ** 2
    if entropic:
        x = reference.local()
        log = pairwise.evaluated(other, KdeLog(x.x, x.w), 1)[:, 0]
        value -= log.mean() / len(log)
    return _root(value)


def amcmd(reference: Points, other: Points, feature: Kernel, response: Kernel, reg: float = 1e-6, weighting: Points | None = None, limit: int = 2_000) -> float:
    """Average maximum conditional mean discrepancy: dense solves of both sizes up to `limit` points each, beyond it solves for the different responses."""
    if reg < 0:
        raise ValueError(f"reg is {reg}; a negative one has no meaning here")
    a, b = reference.local(), other.local()
    z = (weighting.local() if weighting else a).x
    if max(len(a), len(b), len(z)) > limit:
        return _amcmd_many(reference.df.sparkSession, a, b, z, feature, response, reg)
    ia = np.linalg.lstsq(feature(a.x, a.x) + reg * np.eye(len(a)), feature(a.x, z), rcond=None)[0]
    ib = np.linalg.lstsq(feature(b.x, b.x) + reg * np.eye(len(b)), feature(b.x, z), rcond=None)[0]
    one = np.einsum("iq,ij,jq->", ia, response(a.y, a.y), ia)
    two = np.einsum("iq,ij,jq->", ib, response(b.y, b.y), ib)
    three = np.einsum("iq,ij,jq->", ia, response(a.y, b.y), ib)
    return _root((one + two - 2 * three) / len(z))


def _amcmd_many(spark, a, b, z, feature: Kernel, response: Kernel, reg: float) -> float:
    """The conditional means of each different response by a factor in place, by conjugate gradients on the executors, or by the kernel's features: equal responses share a solve."""
    every, of = np.unique(np.concatenate((a.y, b.y)), axis=0, return_inverse=True)
    if max(len(a), len(b), len(z)) * len(every) * 8 > LOCAL_BYTES:
        raise ValueError(f"{len(every)} different responses of {len(a)} and {len(b)} points are too many for one process")
    if not reg and feature.features(z[:1]) is None:
        raise ValueError("of many points reg must be positive")
    means = []
    for x, own in ((a.x, of.ravel()[: len(a)]), (b.x, of.ravel()[len(a) :])):
        f = feature.features(x)
        if f is None:
            target = np.zeros((len(x), len(every)))
            target[np.arange(len(x)), own] = 1
            table = pairwise.gram(spark, x, feature, LOCAL_BYTES)
            if isinstance(table, np.ndarray):
                table[np.diag_indices(len(x))] += reg
                solved = cholesky_solve(table, target)
            else:
                solved = conjugate_gradients(table.shifted(reg), target, nearby(lambda at: feature(x, x[at : at + 1])[:, 0], feature.diagonal(x), reg))  # noqa: B023
            del table
            means.append(pairwise.products(spark, z, x, feature, solved))
        else:
            sums = np.stack([np.bincount(own, c, len(every)) for c in f.T])
            means.append(feature.features(z) @ np.linalg.lstsq(f.T @ f + reg * np.eye(f.shape[1]), sums, rcond=None)[0])
    apart = means[0] - means[1]
    return _root(((apart @ response(every, every)) * apart).sum() / len(z))
