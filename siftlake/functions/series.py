"""Chebyshev series in boxes: smooth functions of few coordinates from their values at few nodes."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np

#: What is left out of a series, what of its coefficients is rounding, and what its last coefficients may be, as parts of the largest.
DROPPED, NOISE, LAST = 1e-17, 2.0**-54, 1e-13


def _polynomials(u: np.ndarray, n: int) -> np.ndarray:
    """The first n Chebyshev polynomials at u: (n, len(u))."""
    out = np.ones((n, len(u)))
    if n > 1:
        out[1] = u
    for k in range(2, n):
        np.multiply(u, out[k - 1], out=out[k])
        out[k] *= 2
        out[k] -= out[k - 2]
    return out


def _series(c: np.ndarray, t: list[np.ndarray]) -> np.ndarray:
    """The series with coefficients c of the polynomials t of each coordinate, the small ones first: column by column of t the same wherever it stands."""
    out, part = np.zeros(t[0].shape[1]), np.empty(t[0].shape[1])
    for k in np.flatnonzero(c.any(axis=tuple(range(1, c.ndim))))[::-1]:
        out += np.multiply(t[0][k], c[k] if c.ndim == 1 else _series(c[k], t[1:]), out=part)
    return out


@dataclass(frozen=True)
class Interpolant:
    """A box cut into equal cells, each with the nodes of a product of Chebyshev polynomials."""

    low: np.ndarray
    width: np.ndarray  # of a cell
    cells: tuple[int, ...]
    degrees: tuple[int, ...]  # nodes of a cell along each coordinate
    series: np.ndarray | None = None  # (cells, columns, *degrees)

    @classmethod
    def over(cls, box: np.ndarray, reach: float) -> Interpolant:
        """For functions that are analytic and bounded up to `reach` from the real box (rows of least and largest).

        The ellipse round a cell of half width h whose half axis is `reach` has the sum of axes rho below; degree n leaves rho**-n.
        """
        low, high = box.T
        cells = tuple(max(1, math.ceil(v)) for v in (high - low) / reach)
        width = np.where(high > low, (high - low) / cells, 1.0)
        rho = 2 * reach / width + np.sqrt((2 * reach / width) ** 2 + 1)
        degrees = tuple(1 if b <= a else 5 + math.ceil(-math.log(DROPPED) / math.log(r)) for a, b, r in zip(low, high, rho, strict=True))
        return cls(np.where(high > low, low, low - 0.5), width, cells, degrees)

    @property
    def count(self) -> int:
        return math.prod(self.cells) * math.prod(self.degrees)

    def nodes(self) -> np.ndarray:
        """The nodes cell by cell, the last coordinate first to change."""
        one = [np.cos(np.pi * (np.arange(n) + 0.5) / n) for n in self.degrees]
        own = np.array(list(itertools.product(*one)))
        cells = np.array(list(itertools.product(*map(range, self.cells))))
        return (self.low + self.width * (cells[:, None, :] + (own[None] + 1) / 2)).reshape(-1, len(self.low))

    def fitted(self, values: np.ndarray) -> Interpolant | None:
        """With the series through values (a row for each node); None where their last coefficients are not small or not finite."""
        c = np.moveaxis(values.reshape(math.prod(self.cells), math.prod(self.degrees), -1), 2, 1).reshape(math.prod(self.cells), values.shape[1], *self.degrees)
        for axis, n in enumerate(self.degrees):
            to = np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n) * 2 / n
            to[0] /= 2
            c = np.moveaxis(np.tensordot(to, c, (1, axis + 2)), 0, axis + 2)
        size = np.abs(c).max(axis=(0, *range(2, c.ndim)))
        for axis, n in enumerate(self.degrees):
            last = np.abs(np.take(c, range(max(1, n - 2), n), axis + 2)).max(axis=(0, *range(2, c.ndim)), initial=0)
            if not (last <= LAST * size).all():
                return None
        c[np.abs(c) <= NOISE * size.reshape(-1, *[1] * len(self.degrees))] = 0
        return replace(self, series=np.ascontiguousarray(c))

    def _within(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its place in [-1, 1] of its cell, and the cell; a row with NaN is in any."""
        at = np.nan_to_num(np.clip(np.floor((x - self.low) / self.width), 0, np.array(self.cells) - 1))
        return 2 * ((x - self.low) / self.width - at) - 1, np.ravel_multi_index(at.astype(np.int64).T, self.cells)

    def moments(self, x: np.ndarray, q: np.ndarray, entries: int = 1 << 18) -> np.ndarray:
        """(cells, columns of q, *degrees): of each cell the sums of q times the polynomials at its rows. With them the sums over all rows
        of q times any function with a series here are sums over its coefficients."""
        out = np.zeros((math.prod(self.cells), math.prod(self.degrees[:-1]), q.shape[1] * self.degrees[-1]))
        step = max(64, entries // out.shape[2])
        for lo in range(0, len(x), step):
            u, cell = self._within(x[lo : lo + step])
            for k in np.unique(cell):
                own = slice(None) if (cell == k).all() else np.flatnonzero(cell == k)
                v, at = q[lo : lo + step][own].T, u[own].T
                left = np.ones((1, v.shape[1]))
                for i, n in enumerate(self.degrees[:-1]):
                    left = (left[:, None] * _polynomials(at[i], n)).reshape(-1, v.shape[1])
                out[k] += left @ (v[:, None] * _polynomials(at[-1], self.degrees[-1])).reshape(-1, v.shape[1]).T
        return np.moveaxis(out.reshape(len(out), *self.degrees[:-1], q.shape[1], self.degrees[-1]), -2, 1)

    def against(self, moments: np.ndarray) -> np.ndarray:
        """(columns, columns of moments): the sums of each column's function over the rows of the moments."""
        axes = (0, *range(2, moments.ndim))
        return np.tensordot(self.series, moments, (axes, axes))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, columns)."""
        u, cell = self._within(x)
        out = np.empty((len(x), self.series.shape[1]))
        for k in np.unique(cell):
            own = slice(None) if (cell == k).all() else np.flatnonzero(cell == k)
            t = [_polynomials(u[own, i], n) for i, n in enumerate(self.degrees)]
            for j, c in enumerate(self.series[k]):
                out[own, j] = _series(c, t)
        return out
