import numpy as np
import pytest

from siftlake.functions import kernels as K
from siftlake.functions.linalg import MinimalNorm, RandomisedEigen

SMOOTH = [
    K.Linear(0.7, 0.3), K.Polynomial(0.7, 0.3, 3), K.SquaredExponential(0.8, 1.3), K.PCIMQ(0.8, 1.3), K.RationalQuadratic(0.8, 1.3, 1.7),
    K.Matern(0.8, 1.3, 1), K.Matern(0.8, 1.3, 3), K.Periodic(0.8, 1.3, 2.0), K.Poisson(0.4, 1.3), K.locally_periodic(K.Periodic(1.1, 0.6, 2.0)),
    K.Exponential(0.8, 1.3), K.Laplacian(0.9, 1.3), K.Matern(0.8, 1.3, 0),
    K.PCIMQ(0.8, 1.3) + K.Linear(0.5, 0.2), K.PCIMQ(0.8, 1.3) * K.SquaredExponential(1.1, 0.7), K.PCIMQ(0.8, 1.3) ** 3, 2 * K.SquaredExponential(1.0, 1.0) + 1,
]


@pytest.mark.parametrize("kernel", SMOOTH, ids=str)
@pytest.mark.parametrize("d", [1, 3])
def test_derivatives_match_finite_differences(kernel, d):
    rng = np.random.default_rng(5)
    x, y, h = rng.normal(size=(6, d)), rng.normal(size=(5, d)), 1e-4
    gx, gy, div = kernel.grad_x(x, y), kernel.grad_y(x, y), np.zeros((6, 5))
    for i in range(d):
        e = np.zeros(d)
        e[i] = h
        assert np.allclose(gx[:, :, i], (kernel(x + e, y) - kernel(x - e, y)) / (2 * h), atol=1e-5)
        assert np.allclose(gy[:, :, i], (kernel(x, y + e) - kernel(x, y - e)) / (2 * h), atol=1e-5)
        div += (kernel(x + e, y + e) - kernel(x + e, y - e) - kernel(x - e, y + e) + kernel(x - e, y - e)) / (4 * h * h)
    assert np.allclose(kernel.divergence(x, y), div, atol=1e-5)


@pytest.mark.parametrize("kernel", SMOOTH, ids=str)
def test_symmetry_and_diagonal(kernel):
    x = np.random.default_rng(1).normal(size=(7, 2))
    assert np.allclose(kernel(x, x), kernel(x, x).T)
    assert np.allclose(kernel.diagonal(x), np.diag(kernel(x, x)))


@pytest.mark.parametrize("kernel", SMOOTH, ids=str)
@pytest.mark.parametrize("n", [0, 1, 70])
def test_paired_values_are_those_of_all_pairs(kernel, n):
    x, y = np.random.default_rng(4).normal(size=(2, n, 3))
    at = np.arange(n)
    assert np.allclose(kernel.elementwise(x, y), kernel(x, y)[at, at])
    assert np.allclose(K.paired(kernel.grad_x, x, y), kernel.grad_x(x, y)[at, at])
    assert np.allclose(K.paired(kernel.divergence, x, y), kernel.divergence(x, y)[at, at])
    with pytest.raises(ValueError):
        kernel.elementwise(x, np.zeros((n + 1, 3)))


def test_square_root_kernel():
    root = K.SquaredExponential(1.5, 2.0).sqrt_kernel(1)
    z = np.linspace(-30, 30, 20001)[:, None]
    x, y = np.array([[0.3]]), np.array([[1.1]])
    value = (root(x, z)[0] * root(y, z)[0]).sum() * (z[1, 0] - z[0, 0])
    assert np.isclose(value, K.SquaredExponential(1.5, 2.0)(x, y)[0, 0], rtol=1e-6)


def test_stein_kernel_closed_form():
    """PCIMQ with score -x, by the generic formula of radial kernels."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 2)), rng.normal(size=(3, 2))
    r2 = K.sq_dist(x, y)
    s = 1 + r2 / 2
    slope = -0.5 * s**-1.5
    want = -(slope + 0.75 * r2 * s**-2.5 + slope) + slope * r2 + s**-0.5 * (x @ y.T)
    assert np.allclose(K.Stein(K.PCIMQ(), np.negative)(x, y), want)


@pytest.mark.parametrize(
    "make",
    [
        lambda: K.Linear(0), lambda: K.Linear(1, -1), lambda: K.Polynomial(degree=1), lambda: K.Polynomial(degree=2.5), lambda: K.SquaredExponential(-1), lambda: K.Matern(degree=-1),
        lambda: K.Poisson(1.0), lambda: K.RationalQuadratic(relative_weighting=-1), lambda: K.PCIMQ() ** 0, lambda: K.PCIMQ() ** 1.5, lambda: K.PCIMQ() + -1, lambda: K.PCIMQ() * "a",
        lambda: K.Stein("no kernel", np.negative), lambda: K.Stein(K.Exponential(), np.negative),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_near_pairs_keep_their_digits():
    x = np.random.default_rng(0).normal(size=(3, 64)) * 100
    assert np.allclose(K.sq_dist(x, x + 1e-7), K.sq_dist(x, x + 1e-7).T)
    assert np.isclose(K.sq_dist(x, x + 1e-7)[0, 0], 64e-14, rtol=1e-3)


def test_least_squares():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 8))
    gram, b = a @ a.T, rng.normal(size=(40, 2))
    want = np.linalg.pinv(gram + 0.0 * np.eye(40), rcond=1e-10) @ b
    assert np.allclose(RandomisedEigen(power_iterations=2, rcond=1e-10).solve(gram, 0.0, b), want, atol=1e-6)
    assert np.allclose(MinimalNorm().solve(gram, -1.0, b), np.linalg.solve(gram + np.eye(40), b))
    assert MinimalNorm().solve_stack(np.stack([gram, gram]), 1.0, np.stack([b, b])).shape == (2, 40, 2)
    for bad in ({"oversampling": 0}, {"power_iterations": -1}, {"rcond": -2}):
        with pytest.raises(ValueError):
            RandomisedEigen(**bad)
