import math

import numpy as np
import pytest

from siftlake.functions import kernels as K
from siftlake.functions import linalg
from siftlake.operators import greedy, recombine, weights
from siftlake.operators.score import ScoreNetwork, kde_score, laplace_correction
from siftlake.operators.solvers import leaves, place, split_tree

HALF = 1 / math.sqrt(2)
F1 = np.array([[0.3, 0.25], [0.4, 0.2], [0.5, 0.125]])
TEN = np.array([[-0.1, -0.1], [-0.3, -0.2], [-0.2, 0.6], [0.8, 0.2], [0, 0.3], [0.9, -0.7], [0.2, -0.1], [0.7, -1.0], [-0.4, -0.4], [0, -0.3]])
STEIN = K.Stein(K.PCIMQ(HALF), np.negative)
ONES = np.ones


def test_herding_of_three_points():
    se = K.SquaredExponential(HALF)
    assert np.allclose(greedy.row_mean(F1, ONES(3), se), [0.97782386, 0.99069141, 0.97679674], atol=1e-7)
    assert greedy.herding(F1, ONES(3), 2, se).tolist() == [1, 2]
    assert greedy.herding(F1, ONES(3), 2, se, unique=False).tolist() == [1, 1]
    assert greedy.herding(F1, np.array([0.8, 0.1, 0.1]), 2, se).tolist() == [0, 1]


def test_herding_and_refinement_of_a_hundred_points():
    x = np.random.default_rng(97).uniform(size=(100, 2))
    got = greedy.herding(x, ONES(100), 10, K.PCIMQ())
    assert got.tolist() == [94, 62, 54, 15, 85, 72, 1, 31, 32, 86]
    assert greedy.herding(x, ONES(100), 10, K.PCIMQ(), chosen=got).tolist() == [97, 73, 10, 15, 85, 40, 1, 70, 32, 86]


def test_stein_thinning():
    assert greedy.stein(TEN, ONES(10), 10, STEIN, weight=0).tolist() == [0, 3, 2, 7, 8, 5, 4, 1, 6, 9]
    assert greedy.stein(TEN, ONES(10), 10, STEIN, unique=False, weight=0).tolist() == [0, 3, 2, 7, 8, 2, 5, 8, 3, 2]
    laplace = laplace_correction(np.negative)(TEN)
    assert greedy.stein(TEN, ONES(10), 10, STEIN, weight=1, laplace=laplace).tolist() == [0, 2, 5, 8, 6, 3, 1, 4, 7, 9]


def test_rp_cholesky_with_largest_pivots():
    x = np.array([[0.5, 0.2], [0.4, 0.6], [0.8, 0.3]])
    got = greedy.rp_cholesky(x, ONES(3), 2, K.SquaredExponential(HALF))
    assert got.chosen.tolist() == [2, 1]
    assert np.allclose(got.residual, [0.13218, 0, 0], atol=1e-5)


def test_greedy_kernel_points():
    x, y = np.array([[1.0, 0], [0, 1], [2, 1]]), np.array([[0.0], [1], [5]])
    assert greedy.greedy_kernel_points(x, y, ONES(3), 2, K.Linear()).tolist() == [2, 1]


def test_kernel_halving():
    x = np.array([0.7, 0.55, 0.6, 0.65, 0.9, 0.10, 0.11, 0.12])[:, None]
    first, second = greedy.kt_half(x, K.SquaredExponential(HALF), 1 / 8, np.full(4, 0.5))
    assert x[first, 0].tolist() == [0.55, 0.65, 0.9, 0.11]
    assert x[second, 0].tolist() == [0.7, 0.6, 0.1, 0.12]


def test_thinning_and_compression_beat_chance():
    x = np.random.default_rng(8).normal(size=(1024, 2))
    k, w = K.SquaredExponential(1.0), ONES(1024)
    root = k.sqrt_kernel(2)
    chance = np.mean([greedy.mmd(x, w, x[np.random.default_rng(s).permutation(1024)[:16]], ONES(16), k) for s in range(10)])
    for got in (greedy.kernel_thinning(x, w, 16, k, root), greedy.compress(x, w, 16, 3, k, root)):
        assert len(set(got.tolist())) == 16
        assert greedy.mmd(x, w, x[got], ONES(16), k) < chance / 2
    for g, m in ((-1, 4), (6, 4), (0, 40)):
        with pytest.raises(ValueError):
            greedy.compress(x, w, m, g, k, root)


@pytest.mark.parametrize("run", [
    lambda x, w: greedy.herding(x, w, 5, K.PCIMQ()), lambda x, w: greedy.stein(x, w, 5, STEIN), lambda x, w: greedy.rp_cholesky(x, w, 5, K.PCIMQ()).chosen,
    lambda x, w: greedy.greedy_kernel_points(x, x[:, :1], w, 5, K.PCIMQ()),
])
def test_points_of_zero_weight_are_never_chosen(run):
    x = np.random.default_rng(4).normal(size=(30, 2))
    w = np.r_[np.zeros(10), np.ones(20)]
    got = run(x, w)
    assert len(set(got.tolist())) == 5 and got.min() >= 10


def test_discrepancy_values():
    a, b = np.array([[0.0, 0], [1, 1], [2, 2]]), np.array([[0.0, 0], [1, 1]])
    se = K.SquaredExponential(1.0)
    assert np.isclose(greedy.mmd(a, ONES(3), b, ONES(2), se), 0.3797287, atol=1e-7)
    assert np.isclose(greedy.mmd(a, ONES(3), b, np.array([1.0, 0]), se) ** 2, 2 / 3 - 2 / 9 * math.exp(-1) - 4 / 9 * math.exp(-4))
    z = se(a, b).mean(0)
    assert np.allclose(weights.sbq(se(b, b), z), [0.28822, 0.47256], atol=1e-5)
    w = weights.simplex(se(b, b), z)
    assert np.isclose(w[0], 0.407833, atol=1e-6) and np.isclose(w.sum(), 1)


def test_simplex_weights_are_optimal():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x, c = rng.normal(size=(60, 2)), rng.normal(size=(8, 2)) * 2
        k = K.SquaredExponential(1.0)
        gram, z = k(c, c), k(x, c).mean(0)
        w = weights.simplex(gram, z)
        slope = gram @ w - z
        assert w.min() >= 0 and np.isclose(w.sum(), 1)
        assert slope[w > 1e-9].max() - slope.min() < 1e-6


@pytest.mark.parametrize("solve", [recombine.caratheodory, recombine.tree])
@pytest.mark.parametrize("kind", ["full", "zero weights", "rank deficient", "many tests", "constant"])
def test_recombination(solve, kind):
    rng = np.random.default_rng(9)
    values, w = rng.normal(size=(64, 3)), rng.uniform(size=64)
    if kind == "zero weights":
        w[::3] = 0
    if kind == "rank deficient":
        values[:, 2] = values[:, 0] + values[:, 1]
    if kind == "many tests":
        values = rng.normal(size=(64, 80))
    if kind == "constant":
        values = np.ones((64, 2))
    w /= w.sum()
    got = solve(values, w)
    assert got.min() >= 0 and np.isclose(got.sum(), 1)
    assert np.allclose(got @ values, w @ values, rtol=1e-5, atol=1e-9)
    assert (got > 0).sum() <= np.linalg.matrix_rank(np.column_stack((np.ones(64), values))[w > 0])
    assert (got[w == 0] == 0).all()


def test_kde_score_is_the_gradient():
    x = np.random.default_rng(1).normal(size=(50, 2))
    score, at = kde_score(x, 0.7), np.random.default_rng(2).normal(size=(5, 2))
    k = K.SquaredExponential(0.7)
    for i in range(2):
        e = np.eye(2)[i] * 1e-5
        want = (np.log(k(at + e, x).sum(1)) - np.log(k(at - e, x).sum(1))) / 2e-5
        assert np.allclose(score(at)[:, i], want, atol=1e-6)
    assert score(at[0]).shape == (2,)


def test_score_network_gradients_and_fit():
    rng = np.random.default_rng(3)
    net = ScoreNetwork((6, 5), epochs=0).fit(rng.normal(size=(10, 2)))
    x, v = rng.normal(size=(7, 2)), rng.normal(size=(7, 2))

    def loss():
        s, h = net(x), 1e-5
        jv = (net(x + h * v) - net(x - h * v)) / (2 * h)
        return ((v * jv).sum(1) + 0.5 * (v * s).sum(1) ** 2).mean()

    grads = net._gradients(x, v, 1.0)
    for layer, g in zip(net.layers, grads, strict=True):
        for p, q in zip(layer, g, strict=True):
            at = (0,) * p.ndim
            p[at] += 1e-4
            up = loss()
            p[at] -= 2e-4
            down = loss()
            p[at] += 1e-4
            assert np.isclose(q[at], (up - down) / 2e-4, atol=1e-4)
    data = np.random.default_rng(4).normal(size=(2000, 1))
    fitted = ScoreNetwork((32,), epochs=40, rate=5e-3).fit(data)
    grid = np.linspace(-1.5, 1.5, 13)[:, None]
    assert np.abs(fitted(grid) + grid).mean() < 0.25
    noisy = ScoreNetwork((32,), epochs=20, rate=5e-3, sigma=0.3).fit(data)
    assert np.abs(noisy(grid) + grid).mean() < 0.4


def test_partition_sizes():
    assert [leaves(n, 6) for n in (21, 12, 6)] == [4, 2, 1]
    x = np.random.default_rng(0).normal(size=(1024, 3))
    counts = np.bincount(place(x, split_tree(x, 4)), minlength=16)
    assert counts.tolist() == [64] * 16


def test_delta():
    assert np.isclose(greedy.delta_for(100), 1 / (100 * math.log(math.log(100))))
    assert np.isclose(greedy.delta_for(2), 1 / (2 * math.log(2)))
    assert greedy.delta_for(1) == 1


def test_stein_thinning_of_cached_scores_is_that_of_the_kernel():
    x, w = np.random.default_rng(14).normal(size=(120, 2)), np.random.default_rng(15).uniform(0.5, 1, 120)
    score = kde_score(x, 0.9)
    kernel = K.Stein(K.PCIMQ(), score)
    assert np.allclose(kernel.diagonal(x), np.diagonal(kernel(x, x)))
    both = score.with_curvature(x)
    assert np.allclose(both[0], score(x)) and np.allclose(both[1], laplace_correction(score)(x), atol=1e-6)
    log = greedy.kde_log(x, w, x)
    assert np.allclose(greedy.kde_log(x, w, x, pairs=500), log)
    want = []
    for i in range(6):
        value = np.diagonal(kernel(x, x)) + 2 * kernel(x, x[want]).sum(1) + both[1] - log * (i + 1) / 6
        value[want] = np.inf
        want.append(int(np.argmin(value)))
    assert greedy.stein(x, w, 6, kernel, laplace=both[1]).tolist() == want


def test_greedy_kernel_points_refined():
    """Each place anew is never worse; the result is the best single change of each place in turn."""
    rng = np.random.default_rng(16)
    x, k = rng.normal(size=(60, 2)), K.SquaredExponential(1.0)
    y = np.sin(x[:, :1])

    def loss(own):
        fit = k(x, x[own]) @ np.linalg.solve(k(x[own], x[own]) + 1e-6 * np.eye(len(own)), y[own, 0])
        return fit @ fit - 2 * fit @ y[:, 0]

    first = [3, 4, 5]
    got = greedy.greedy_kernel_points(x, y, ONES(60), 3, k, chosen=np.array(first)).tolist()
    want = list(first)
    for i in range(3):
        tried = {j: loss(want[:i] + want[i + 1 :] + [j]) for j in range(60) if j not in want[:i] + want[i + 1 :]}
        want[i] = min(tried, key=tried.get)
    assert got == want and loss(got) < loss(first)


def test_stacks_of_systems():
    rng = np.random.default_rng(17)
    a, b = rng.normal(size=(5, 4, 4)), rng.normal(size=(5, 4))
    a[1, 2] = a[1, 1]  # singular
    for solver in (linalg.MinimalNorm(), linalg.MinimalNorm(1e-9)):
        assert np.allclose(solver.solve_stack(a, 0, b), [solver.solve(p, 0, q) for p, q in zip(a, b, strict=True)])
    sym = a @ a.transpose(0, 2, 1)
    eigen = linalg.RandomisedEigen(oversampling=4)
    assert np.allclose(eigen.solve_stack(sym, 0.1, b), linalg.MinimalNorm().solve_stack(sym, 0.1, b))
    for bad in ({"oversampling": 0}, {"power_iterations": -1}, {"rcond": -0.5}):
        with pytest.raises(ValueError):
            linalg.RandomisedEigen(**bad)
