"""Kernels: a numpy form for blocks, an SQL form over distance, L1 distance and inner product, and closed-form derivatives."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"'{name}' must be positive")


def sq_dist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, by differences where rows are short and by one matrix product where they are long."""
    if x.shape[1] <= 8:
        out = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            apart = x[:, i, None] - y[None, :, i]
            apart *= apart
            out += apart
        return out
    a, b = (x * x).sum(1), (y * y).sum(1)
    out, dot = a[:, None] + b[None, :], x @ y.T
    dot *= 2
    out -= dot
    if out.size and not out.min() > 1e-6 * (a.max() + b.max()):
        i, j = np.nonzero(out <= 1e-6 * (a[:, None] + b[None, :]))  # cancelled digits: near pairs are taken by differences
        out[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.maximum(out, 0, out=out)


def paired(function: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, block: int = 32) -> np.ndarray:
    """Of function(x, y), such as a kernel or its grad_x, the values where both rows have the same position; from small blocks."""
    if len(x) != len(y):
        raise ValueError(f"{len(x)} rows can't be paired with {len(y)}")
    parts = [function(x[i : i + block], y[i : i + block]) for i in range(0, max(1, len(x)), block)]
    return np.concatenate([p[np.arange(len(p)), np.arange(len(p))] for p in parts])


class Kernel:
    """k(x, y); +, * and ** build other kernels."""

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def elementwise(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """k of the first rows of x and y, of the second rows, and so on."""
        return paired(self, x, y)

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        return self.elementwise(x, x)

    def features(self, x: np.ndarray) -> np.ndarray | None:
        """Few columns f with k(x, y) = f(x) f(y)', where the kernel has such."""
        return None

    def smooth(self) -> float | None:
        """How far from real points k(., y) is analytic in each coordinate and of a bounded size; None: not known."""
        return None

    def terms(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Columns of sums over y that are as smooth in x as k(., y)."""
        return (self(x, y) @ w)[:, None]

    def of_terms(self, x: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """k(x, y) @ w of the terms at x."""
        return terms[:, 0]

    def tables(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Functions of all pairs, as smooth in both as k, of which the terms are sums."""
        return (self(x, y),)

    def charges(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Columns of numbers of y by which the tables are summed up for the terms."""
        return w[:, None]

    def of_tables(self, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The terms at x of sums[t, i, c], of table t over all y by charge c."""
        return sums[0]

    def sql(self, r: str, l1: str, dot: str) -> str:
        """The kernel as SQL; r, l1 and dot are expressions for the distances and the inner product."""
        raise NotImplementedError

    def grad_x(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def grad_y(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def divergence(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Trace of the mixed second derivative d/dx d/dy."""
        raise NotImplementedError

    def __add__(self, other):
        return Additive(self, _kernel(other, "+"))

    __radd__ = __add__

    def __mul__(self, other):
        return Product(self, _kernel(other, "*"))

    __rmul__ = __mul__

    def __pow__(self, power):
        return Power(self, power)


def _kernel(other, sign: str) -> Kernel:
    if isinstance(other, Kernel):
        return other
    if isinstance(other, (int, float)) and not isinstance(other, bool):
        if other < 0:
            raise ValueError("a constant must not be negative")
        return Constant(float(other))
    raise ValueError(f"a kernel {sign} {type(other).__name__} has no meaning")


@dataclass(frozen=True)
class Constant(Kernel):
    value: float = 1.0

    def __call__(self, x, y):
        return np.full((len(x), len(y)), self.value)

    def sql(self, r, l1, dot):
        return f"CAST({self.value!r} AS DOUBLE)"

    def grad_x(self, x, y):
        return np.zeros((len(x), len(y), x.shape[1]))

    grad_y = grad_x

    def divergence(self, x, y):
        return np.zeros((len(x), len(y)))


@dataclass(frozen=True)
class Linear(Kernel):
    output_scale: float = 1.0
    constant: float = 0.0

    def __post_init__(self):
        _positive(output_scale=self.output_scale)
        if self.constant < 0:
            raise ValueError("'constant' must not be negative")

    def __call__(self, x, y):
        return self.output_scale * (x @ y.T) + self.constant

    def features(self, x):
        return np.column_stack((math.sqrt(self.output_scale) * x, np.full(len(x), math.sqrt(self.constant))))

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * ({dot}) + {self.constant!r})"

    def grad_x(self, x, y):
        return np.broadcast_to(self.output_scale * y[None, :, :], (len(x), *y.shape)).copy()

    def grad_y(self, x, y):
        return np.broadcast_to(self.output_scale * x[:, None, :], (len(x), *y.shape)).copy()

    def divergence(self, x, y):
        return np.full((len(x), len(y)), self.output_scale * x.shape[1])


@dataclass(frozen=True)
class Polynomial(Kernel):
    output_scale: float = 1.0
    constant: float = 0.0
    degree: int = 2

    def __post_init__(self):
        _positive(output_scale=self.output_scale)
        if not isinstance(self.degree, int) or self.degree < 2:
            raise ValueError("'degree' must be an integer of at least 2")
        if self.constant < 0:
            raise ValueError("'constant' must not be negative")

    def __call__(self, x, y):
        return self.output_scale * (x @ y.T + self.constant) ** self.degree

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * pow(({dot}) + {self.constant!r}, {self.degree}))"

    def _outer(self, x, y):
        return self.output_scale * self.degree * (x @ y.T + self.constant) ** (self.degree - 1)

    def grad_x(self, x, y):
        return self._outer(x, y)[:, :, None] * y[None, :, :]

    def grad_y(self, x, y):
        return self._outer(x, y)[:, :, None] * x[:, None, :]

    def divergence(self, x, y):
        dot = x @ y.T
        inner = self.output_scale * self.degree * (self.degree - 1) * (dot + self.constant) ** (self.degree - 2)
        return inner * dot + x.shape[1] * self._outer(x, y)


@dataclass(frozen=True)
class Laplacian(Kernel):
    length_scale: float = 1.0
    output_scale: float = 1.0

    def __post_init__(self):
        _positive(length_scale=self.length_scale, output_scale=self.output_scale)

    def __call__(self, x, y):
        d = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            d += np.abs(x[:, i, None] - y[None, :, i])
        return self.output_scale * np.exp(-d / (2 * self.length_scale**2))

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * exp(-(({l1}) / {2 * self.length_scale**2!r})))"

    def grad_y(self, x, y):
        return np.sign(x[:, None, :] - y[None, :, :]) * (self(x, y) / (2 * self.length_scale**2))[:, :, None]

    def grad_x(self, x, y):
        return -self.grad_y(x, y)

    def divergence(self, x, y):
        return -x.shape[1] * self(x, y) / (4 * self.length_scale**4)


class Radial(Kernel):
    """phi(|x - y|); `parts` gives phi, phi'/r and phi'' with their limits at 0."""

    def parts(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def phi(self, r: np.ndarray) -> np.ndarray:
        return self.parts(r)[0]

    def __call__(self, x, y):
        r = sq_dist(x, y)
        return self.phi(np.sqrt(r, out=r))

    def diagonal(self, x):
        return np.full(len(x), float(self.phi(np.zeros(1))[0]))

    def grad_x(self, x, y):
        _, slope, _ = self.parts(np.sqrt(sq_dist(x, y)))
        return slope[:, :, None] * (x[:, None, :] - y[None, :, :])

    def grad_y(self, x, y):
        return -self.grad_x(x, y)

    def divergence(self, x, y):
        _, slope, second = self.parts(np.sqrt(sq_dist(x, y)))
        return -(second + (x.shape[1] - 1) * slope)


@dataclass(frozen=True)
class _Scaled(Radial):
    length_scale: float = 1.0
    output_scale: float = 1.0

    def __post_init__(self):
        _positive(length_scale=self.length_scale, output_scale=self.output_scale)


@dataclass(frozen=True)
class SquaredExponential(_Scaled):
    def __call__(self, x, y):
        k = sq_dist(x, y)
        k *= -1 / (2 * self.length_scale**2)
        np.exp(k, out=k)
        k *= self.output_scale
        return k

    def phi(self, r):
        return self.output_scale * np.exp(-(r**2) / (2 * self.length_scale**2))

    def parts(self, r):
        k, a = self.phi(r), 1 / self.length_scale**2
        return k, -a * k, (a * a * r**2 - a) * k

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * exp(-(pow({r}, 2) / {2 * self.length_scale**2!r})))"

    def smooth(self):
        return 2 * self.length_scale  # there up to exp(2) times as large

    def sqrt_kernel(self, dim: int) -> SquaredExponential:
        return SquaredExponential(self.length_scale / math.sqrt(2), math.sqrt(self.output_scale) * (2 / (math.pi * self.length_scale**2)) ** (dim / 4))


@dataclass(frozen=True)
class Exponential(_Scaled):
    """Not differentiable where x = y: the slope there is infinite."""

    def phi(self, r):
        return self.output_scale * np.exp(-r / (2 * self.length_scale**2))

    def parts(self, r):
        k, a = self.phi(r), 1 / (2 * self.length_scale**2)
        with np.errstate(divide="ignore"):
            return k, -a * k / r, a * a * k

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * exp(-(({r}) / {2 * self.length_scale**2!r})))"


@dataclass(frozen=True)
class PCIMQ(_Scaled):
    def phi(self, r):
        return self.output_scale / np.sqrt(1 + r**2 / (2 * self.length_scale**2))

    def parts(self, r):
        a = 1 / (2 * self.length_scale**2)
        s = 1 + a * r**2
        k = self.output_scale / np.sqrt(s)
        slope = -a * k / s
        return k, slope, slope * (1 - 3 * a * r**2 / s)

    def smooth(self):
        return 1.2 * self.length_scale  # the poles are sqrt(2) length scales away

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} / sqrt(1 + pow({r}, 2) / {2 * self.length_scale**2!r}))"


@dataclass(frozen=True)
class RationalQuadratic(_Scaled):
    relative_weighting: float = 1.0

    def __post_init__(self):
        super().__post_init__()
        if self.relative_weighting < 0:
            raise ValueError("'relative_weighting' must not be negative")

    def parts(self, r):
        a, b = self.relative_weighting, 1 / self.length_scale**2
        if a == 0:
            return np.full_like(r, self.output_scale), np.zeros_like(r), np.zeros_like(r)
        s = 1 + b * r**2 / (2 * a)
        slope = -self.output_scale * b * s ** (-a - 1)
        return self.output_scale * s**-a, slope, slope + self.output_scale * b * b * (a + 1) / a * r**2 * s ** (-a - 2)

    def sql(self, r, l1, dot):
        a = self.relative_weighting
        return f"({self.output_scale!r} * pow(1 + pow({r}, 2) / {2 * a * self.length_scale**2!r}, {-a!r}))" if a else f"CAST({self.output_scale!r} AS DOUBLE)"


@dataclass(frozen=True)
class Matern(_Scaled):
    degree: int = 1

    def __post_init__(self):
        super().__post_init__()
        if not isinstance(self.degree, int) or self.degree < 0:
            raise ValueError("'degree' must be an integer and not negative")

    def _poly(self) -> np.ndarray:
        p = self.degree
        if p == 0:
            return np.array([1.0])
        f = math.factorial
        return np.array([f(p) / f(2 * p) * f(p + i) / (f(i) * f(p - i)) * 2.0 ** (p - i) for i in range(p, -1, -1)])

    def phi(self, r):
        b, poly = math.sqrt(2 * self.degree + 1) / self.length_scale * r, self._poly()
        out = np.full_like(b, poly[-1])
        for v in poly[-2::-1]:
            out *= b
            out += v
        np.negative(b, out=b)
        out *= np.exp(b, out=b)
        out *= self.output_scale**2
        return out

    def parts(self, r):
        P = np.polynomial.polynomial
        q, c = self._poly(), math.sqrt(2 * self.degree + 1) / self.length_scale
        first = P.polysub(P.polyder(q), q)
        second = P.polysub(P.polyder(first), first)
        b = c * r
        e = self.output_scale**2 * np.exp(-b)
        top = c * c * e * P.polyval(b, second)
        if self.degree == 0:
            with np.errstate(divide="ignore"):
                return e, -c * e / r, top
        return e * P.polyval(b, q), np.where(r > 0, c * e * P.polyval(b, first) / np.where(r > 0, r, 1), top), top

    def sql(self, r, l1, dot):
        b = f"({math.sqrt(2 * self.degree + 1) / self.length_scale!r} * ({r}))"
        poly = " + ".join(f"{v!r} * pow({b}, {i})" for i, v in enumerate(self._poly().tolist()))
        return f"({self.output_scale**2!r} * exp(-{b}) * ({poly}))"


@dataclass(frozen=True)
class Periodic(_Scaled):
    periodicity: float = 1.0

    def parts(self, r):
        u, a = math.pi * r / self.periodicity, math.pi / self.periodicity
        k = self.output_scale * np.exp(-2 * np.sin(u) ** 2 / self.length_scale**2)
        g = -2 * a / self.length_scale**2 * np.sin(2 * u)
        second = k * (g * g - 4 * a * a / self.length_scale**2 * np.cos(2 * u))
        return k, np.where(r > 0, k * g / np.where(r > 0, r, 1), second), second

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} * exp(-(2 * pow(sin({math.pi / self.periodicity!r} * ({r})), 2) / {self.length_scale**2!r})))"


@dataclass(frozen=True)
class Poisson(Radial):
    index: float = 0.5
    output_scale: float = 1.0

    def __post_init__(self):
        _positive(output_scale=self.output_scale)
        if not 0 < self.index < 1:
            raise ValueError("'index' must be between 0 and 1")

    def parts(self, r):
        q, o = self.index, self.output_scale
        d = 1 - 2 * q * np.cos(r) + q * q
        second = -2 * o * q * np.cos(r) / d**2 + 8 * o * q * q * np.sin(r) ** 2 / d**3
        return o / d, np.where(r > 0, -2 * o * q * np.sin(r) / d**2 / np.where(r > 0, r, 1), second), second

    def sql(self, r, l1, dot):
        return f"({self.output_scale!r} / ({1 + self.index**2!r} - {2 * self.index!r} * cos({r})))"


@dataclass(frozen=True)
class Additive(Kernel):
    first: Kernel
    second: Kernel

    def __call__(self, x, y):
        return self.first(x, y) + self.second(x, y)

    def diagonal(self, x):
        return self.first.diagonal(x) + self.second.diagonal(x)

    def sql(self, r, l1, dot):
        return f"({self.first.sql(r, l1, dot)} + {self.second.sql(r, l1, dot)})"

    def grad_x(self, x, y):
        return self.first.grad_x(x, y) + self.second.grad_x(x, y)

    def grad_y(self, x, y):
        return self.first.grad_y(x, y) + self.second.grad_y(x, y)

    def divergence(self, x, y):
        return self.first.divergence(x, y) + self.second.divergence(x, y)


@dataclass(frozen=True)
class Product(Kernel):
    first: Kernel
    second: Kernel

    def __call__(self, x, y):
        k = self.first(x, y)
        return k * (k if self.first == self.second else self.second(x, y))

    def diagonal(self, x):
        return self.first.diagonal(x) * self.second.diagonal(x)

    def sql(self, r, l1, dot):
        return f"({self.first.sql(r, l1, dot)} * {self.second.sql(r, l1, dot)})"

    def grad_x(self, x, y):
        return self.first.grad_x(x, y) * self.second(x, y)[:, :, None] + self.first(x, y)[:, :, None] * self.second.grad_x(x, y)

    def grad_y(self, x, y):
        return self.first.grad_y(x, y) * self.second(x, y)[:, :, None] + self.first(x, y)[:, :, None] * self.second.grad_y(x, y)

    def divergence(self, x, y):
        a, b = self.first, self.second
        return a.divergence(x, y) * b(x, y) + a(x, y) * b.divergence(x, y) + (a.grad_x(x, y) * b.grad_y(x, y)).sum(2) + (a.grad_y(x, y) * b.grad_x(x, y)).sum(2)


@dataclass(frozen=True)
class Power(Kernel):
    base: Kernel
    power: int

    def __post_init__(self):
        if not isinstance(self.power, int) or isinstance(self.power, bool) or self.power < 1:
            raise ValueError("'power' must be an integer of at least 1")

    def __call__(self, x, y):
        return self.base(x, y) ** self.power

    def diagonal(self, x):
        return self.base.diagonal(x) ** self.power

    def sql(self, r, l1, dot):
        return f"pow({self.base.sql(r, l1, dot)}, {self.power})"

    def grad_x(self, x, y):
        return (self.power * self.base(x, y) ** (self.power - 1))[:, :, None] * self.base.grad_x(x, y)

    def grad_y(self, x, y):
        return (self.power * self.base(x, y) ** (self.power - 1))[:, :, None] * self.base.grad_y(x, y)

    def divergence(self, x, y):
        p, k = self.power, self.base(x, y)
        out = p * k ** (p - 1) * self.base.divergence(x, y)
        return out if p == 1 else out + p * (p - 1) * k ** (p - 2) * (self.base.grad_x(x, y) * self.base.grad_y(x, y)).sum(2)


def locally_periodic(periodic: Periodic | None = None, envelope: SquaredExponential | None = None) -> Product:
    return Product(periodic or Periodic(), envelope or SquaredExponential())


@dataclass(frozen=True)
class Stein(Kernel):
    """The Stein kernel of a base kernel and a score function (rows -> gradients of the log density)."""

    base: Kernel
    score: Callable[[np.ndarray], np.ndarray]

    def __post_init__(self):
        if not isinstance(self.base, Kernel):
            raise ValueError("'base' must be a kernel")
        if isinstance(self.base, (Exponential, Laplacian)) or isinstance(self.base, Matern) and self.base.degree == 0:
            raise ValueError("the base kernel must be differentiable where x = y")

    def __call__(self, x, y):
        return self.between(x, self.score(x), y, self.score(y))

    def between(self, x, sx, y, sy, entries: int = 1 << 16):
        """The same with the scores sx, sy of the rows of x and y, in blocks of about `entries` pairs."""
        out = np.empty((len(x), len(y)))
        chunk = max(1, entries // max(1, len(y)))
        for lo in range(0, len(x), chunk):
            a, s = x[lo : lo + chunk], sx[lo : lo + chunk]
            if isinstance(self.base, Radial):  # both gradients lie along x - y
                k, slope, second = self.base.parts(np.sqrt(sq_dist(a, y)))
                out[lo : lo + chunk] = k * (s @ sy.T) - second + slope * (self._along(a, s, y, sy) - (x.shape[1] - 1))
                continue
            out[lo : lo + chunk] = self.base.divergence(a, y) + np.einsum("ijk,jk->ij", self.base.grad_x(a, y), sy) + np.einsum("ijk,ik->ij", self.base.grad_y(a, y), s) + self.base(a, y) * (s @ sy.T)
        return out

    def smooth(self):
        return self.base.smooth() if isinstance(self.base, Radial) else None

    def terms(self, x, y, w):
        """The kernel is a + b score(x): the columns are the sums of a and, for each coordinate, of b, whatever the score."""
        sy = self.score(y)
        k, slope, second = self.base.parts(np.sqrt(sq_dist(x, y)))
        slope *= w
        a = slope @ -(y * sy).sum(1) + (x * (slope @ sy)).sum(1) - second @ w - (x.shape[1] - 1) * slope.sum(1)
        return np.column_stack((a, k @ (w[:, None] * sy) + slope @ y - x * slope.sum(1)[:, None]))

    def of_terms(self, x, terms):
        return terms[:, 0] + (terms[:, 1:] * self.score(x)).sum(1)

    def tables(self, x, y):
        return self.base.parts(np.sqrt(sq_dist(x, y)))

    def charges(self, y, w):
        sy = self.score(y)
        return w[:, None] * np.column_stack((np.ones(len(y)), (y * sy).sum(1), y, sy))

    def of_tables(self, x, sums):
        """As terms(), for charges 1, y * score, y and score."""
        d = x.shape[1]
        k, slope, second = sums
        a = (x * slope[:, 2 + d :]).sum(1) - slope[:, 1] - second[:, 0] - (d - 1) * slope[:, 0]
        return np.column_stack((a, k[:, 2 + d :] + slope[:, 2 : 2 + d] - x * slope[:, :1]))

    @staticmethod
    def _along(x, sx, y, sy):
        """(x - y) * (sy - sx) of all pairs."""
        if x.shape[1] > 8:
            return x @ sy.T + sx @ y.T - (x * sx).sum(1)[:, None] - (y * sy).sum(1)[None, :]
        out = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            out += (x[:, i, None] - y[None, :, i]) * (sy[None, :, i] - sx[:, i, None])
        return out

    def diagonal(self, x):
        return self.own(x, self.score(x))

    def own(self, x, sx, block: int = 32):
        """k(x, x) of rows with their scores, from diagonals of small blocks."""
        if isinstance(self.base, Radial):
            k, slope, second = (float(v[0]) for v in self.base.parts(np.zeros(1)))
            return k * (sx * sx).sum(1) - second - (x.shape[1] - 1) * slope
        cut = range(0, len(x), block)
        return np.concatenate([np.zeros(0), *(np.diagonal(self.between(x[i : i + block], sx[i : i + block], x[i : i + block], sx[i : i + block])) for i in cut)])
