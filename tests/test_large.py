"""Queries on tables that were too large for them: what is evaluated, not only the result, is bounded."""

import numpy as np
import pytest

from siftlake.functions import kernels as K
from siftlake.functions import linalg
from siftlake.operators import greedy, metrics, pairwise, recombine, score, solvers
from siftlake.plans import catalog
from siftlake.sources.points import Points, from_arrays

SE = K.SquaredExponential(1.0)
X, W = np.random.default_rng(31).uniform(size=(12, 2)), np.random.default_rng(32).uniform(size=240)
REPEATED = np.tile(X, (20, 1))
MATERN = K.Matern(1.0, 1.0, 1)
STEIN = K.Stein(catalog.PCIMQ, catalog.gaussian_score)


def mean(a, b, kernel):
    return W[a] @ kernel(REPEATED[a], REPEATED[b]) @ W[b] / W[a].sum() / W[b].sum()


def rows(kernel):
    return kernel(REPEATED, REPEATED) @ W / W.sum()


def mmd(kernel):
    a, b = np.arange(240) % 3 == 0, np.arange(240) % 3 != 0
    return np.sqrt(mean(a, a, kernel) + mean(b, b, kernel) - 2 * mean(a, b, kernel))


EVERY = np.arange(240)
WANT = {
    "kernel_mean_all": lambda: mean(EVERY, EVERY, SE),
    "stein_kernel_mean": lambda: rows(STEIN),
    "ksd": lambda: np.sqrt(mean(EVERY, EVERY, STEIN)),
    "mmd_weighted": lambda: mmd(catalog.PCIMQ),
    "kernel_mean_weighted": lambda: rows(MATERN),
}


@pytest.mark.parametrize("name", list(WANT))
def test_equal_points_are_evaluated_once(spark, monkeypatch, name):
    """240 points with 12 different vectors: no side of a kernel mean has more than 12 rows."""
    p = from_arrays(spark, REPEATED, W)
    sides, plain = [], pairwise.weighted_sums

    def spy(x, y, *more):
        sides.extend((x.count(), y.count()))
        return plain(x, y, *more)

    def parts(spark, sf_dir, where="true"):
        return type(p)(p.df.where(where.replace("p_partkey", "_idx")))

    monkeypatch.setattr(catalog, "parts", parts)
    monkeypatch.setattr(pairwise, "MERGED_PAIRS", 10)
    monkeypatch.setattr(pairwise, "weighted_sums", spy)
    run = catalog._kernel_query(MATERN, parts) if name == "kernel_mean_weighted" else catalog.QUERIES[name]
    got = run(spark, "")
    column = "mean" if "mean" in got.columns else "value"
    got = [r[column] for r in (got.orderBy("id") if "id" in got.columns else got).collect()]
    assert np.allclose(got, WANT[name](), atol=1e-6)
    assert max(sides) <= 12


@pytest.mark.parametrize("collected", [1 << 20, 1])
@pytest.mark.parametrize("kind", ["plain", "repeated", "even", "equal"])
def test_median_of_all_pairs_of_many_points(spark, monkeypatch, kind, collected):
    rng = np.random.default_rng(35)
    x = {"plain": rng.normal(size=(301, 2)), "repeated": rng.integers(0, 3, (300, 2)), "even": rng.normal(size=(4, 1)), "equal": np.ones((50, 1))}[kind].astype(float)
    s = K.sq_dist(x, x)[np.triu_indices(len(x), 1)]
    p = from_arrays(spark, x)
    assert pairwise.median_distance(p, 16, collected) == np.median(s)
    assert pairwise.median_heuristic(p, x.shape[1], 3).first().length_scale == np.sqrt(np.median(s) / 2)
    if kind == "plain":
        many = from_arrays(spark, rng.normal(size=(5001, 1)))
        monkeypatch.setattr(catalog, "suppliers", lambda *_: many)
        assert 0.6 < catalog.median_heuristic(spark, "").first().length_scale < 0.8


def test_caratheodory_of_many_points(spark, monkeypatch):
    """Twenty thousand points: a table of all their null directions would have 3 GB."""
    rng = np.random.default_rng(36)
    x, w = rng.normal(size=(20_000, 1)), rng.uniform(size=20_000) * (rng.uniform(size=20_000) < 0.9)
    made, plain = [], recombine._null_basis
    monkeypatch.setattr(recombine, "_null_basis", lambda a, rcond: made.append(len(a)) or plain(a, rcond))
    got = recombine.caratheodory(x, w)
    assert max(made) <= 1024 and (got > 0).sum() <= 2 and (got >= 0).all() and not got[w == 0].any()
    assert np.isclose(got.sum(), w.sum()) and np.isclose(got @ x[:, 0], w @ x[:, 0])


def test_conditional_means_by_features(spark):
    """Of a linear kernel the solves are as small as its vectors."""
    rng = np.random.default_rng(34)
    a, b = (from_arrays(spark, rng.normal(size=(n, 1)), None, rng.integers(0, 4, n)) for n in (60, 50))
    for reg in (1e-3, 0):
        want = metrics.amcmd(a, b, K.Linear(1.0, 0.0), SE, reg)
        assert metrics.amcmd(a, b, K.Linear(1.0, 0.0), SE, reg, limit=40) == pytest.approx(want, rel=1e-6)
    many = from_arrays(spark, rng.normal(size=(5100, 1)), None, rng.integers(0, 4, 5100))
    assert metrics.amcmd(many, b, K.Linear(1.0, 0.0), SE, 1e-3) > 0


def test_least_squares_of_a_factored_table(spark, monkeypatch):
    """As of the table itself, with and without a shift; the query makes no table beyond its bytes."""
    rng = np.random.default_rng(37)
    f, b = rng.normal(size=(40, 2)), rng.normal(size=(40, 3))
    for reg in (0.0, 0.3):
        for solver in (linalg.MinimalNorm(1e-9), linalg.RandomisedEigen(oversampling=40, rcond=1e-9)):
            want = linalg.MinimalNorm(1e-9).solve(f @ f.T, reg, b)
            assert np.allclose(solver.solve(linalg.Factored(f), reg, b), want)
            assert np.allclose(solver.solve(linalg.Factored(f), reg, b[:, 0]), want[:, 0])
    p = from_arrays(spark, rng.normal(size=(200, 1)), None, rng.normal(size=200))
    monkeypatch.setattr(catalog, "suppliers", lambda *_, **__: p)
    want = catalog.least_squares(spark, "").collect()
    monkeypatch.setattr(pairwise.gram, "__defaults__", (100,))
    monkeypatch.setattr(K.Linear, "__call__", None)
    got = catalog.least_squares(spark, "").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=2e-6) for r in want]


@pytest.mark.parametrize("name", ["randomised_eigen_linear", "randomised_eigen"])
def test_eigenvalues_without_a_table(spark, monkeypatch, name):
    p = from_arrays(spark, np.random.default_rng(38).normal(size=(300, 1)))
    monkeypatch.setattr(catalog, "suppliers", lambda *_: p)
    want = [r.value for r in catalog.QUERIES[name](spark, "").collect()]
    monkeypatch.setattr(pairwise.gram, "__defaults__", (100,))
    got = [r.value for r in catalog.QUERIES[name](spark, "").collect()]
    assert np.allclose(got, want, atol=2e-6)
    assert isinstance(pairwise.gram(spark, p.local().x, SE), linalg.Gram)


@pytest.mark.parametrize("bytes_", [1 << 28, 1000])
def test_conditional_means_of_many_points(spark, monkeypatch, bytes_):
    """Solves for the different responses, in one process or on executors, are the dense ones."""
    rng = np.random.default_rng(33)
    a, b = (from_arrays(spark, rng.normal(size=(n, 3)), None, rng.integers(0, 4, n)) for n in (60, 50))
    want = metrics.amcmd(a, b, SE, SE, 1e-3)
    monkeypatch.setattr(metrics, "LOCAL_BYTES", bytes_ if bytes_ > 1000 else 60 * 4 * 8)
    assert metrics.amcmd(a, b, SE, SE, 1e-3, limit=40) == pytest.approx(want, rel=1e-8)
    monkeypatch.setattr(catalog, "embeddings", lambda spark, sf_dir, where, y: [big, small]["1" in where.split("=")[1]])
    big, small = (from_arrays(spark, rng.normal(size=(n, 2)), None, rng.integers(0, 4, n)) for n in (5100, 30))
    if bytes_ > 1000:
        assert catalog.amcmd(spark, "").first().value > 0


def _halves(x, kernel, delta, draws):
    """Pair by pair, with the kernel of each to all points."""
    first, seen, chosen, sigma = [], np.zeros(len(x)), np.zeros(len(x)), 0.0
    for i in range(len(x) // 2):
        a, b = 2 * i, 2 * i + 1
        pair = kernel(x, x[a : b + 1])
        gap = max(kernel(x[a : a + 1], x[a : a + 1])[0, 0] + kernel(x[b : b + 1], x[b : b + 1])[0, 0] - 2 * pair[a, 1], 0.0)
        width = max(np.sqrt(gap) * sigma * np.sqrt(2 * np.log(2 / delta)), gap)
        alpha = seen[a] - seen[b] - 2 * (chosen[a] - chosen[b])
        swap = width > 0 and draws[i] <= (1 - alpha / width) / 2
        if width > 0:
            sigma = np.sqrt(sigma**2 + max(gap * (1 + (gap - 2 * width) * sigma**2 / width**2), 0))
        first.append(b if swap else a)
        seen += pair.sum(1)
        chosen += pair[:, int(swap)]
    return first


@pytest.mark.parametrize("n", [200, 201])
def test_halving_in_runs(spark, monkeypatch, n):
    """The same halves; no kernel of a pair to all points, and the sums of whole runs may come from the executors."""
    rng = np.random.default_rng(39)
    x, sides = rng.normal(size=(n, 3)), []
    monkeypatch.setattr(greedy, "HALVED", 32)
    monkeypatch.setattr(solvers, "LOCAL_PAIRS", 4 * 32 * 100)
    plain = solvers.later_sums
    monkeypatch.setattr(solvers, "later_sums", lambda *a: sides.append((len(a[2]), len(a[3]))) or plain(*a))
    p = from_arrays(spark, x)
    monkeypatch.setattr(catalog, "embeddings", lambda *_: p)
    got = [r.id for r in catalog.kernel_halving(spark, "").orderBy("pos").collect()]
    assert got == _halves(x, SE, 0.1, np.full(n, 0.5))
    assert sides == [(2 * (n // 2) - 32 * i, 32) for i in range(1, 7)]
    draws = rng.random(n // 2)
    assert greedy.kt_half(x, SE, 0.3, draws)[0].tolist() == _halves(x, SE, 0.3, draws)


@pytest.mark.parametrize("name", ["stein_thinning_regularised", "herding_weighted"])
def test_greedy_choice_evaluates_equal_points_once(spark, monkeypatch, name):
    """The same choice, of equal points the first; 12 different of 240 are evaluated."""
    p, seen = from_arrays(spark, REPEATED, np.tile(W[:12], 20)), []
    monkeypatch.setattr(catalog, "parts", lambda *_: p)
    want = [r.id for r in catalog.QUERIES[name](spark, "").orderBy("pos").collect()]
    for module, name_, value in ((solvers, "LOCAL_PAIRS", 10), (pairwise, "MERGED_PAIRS", 10)):
        monkeypatch.setattr(module, name_, value)
    for name_ in ("evaluated", "weighted_sums"):
        plain = getattr(pairwise, name_)
        monkeypatch.setattr(pairwise, name_, lambda p, *a, plain=plain: seen.append(p.count()) or plain(p, *a))
    assert [r.id for r in catalog.QUERIES[name](spark, "").orderBy("pos").collect()] == want
    assert seen and max(seen) <= 12
    kept = score.KdeScore(REPEATED, 1.0)
    assert len(kept.x) == 12 and np.allclose(kept(X), score.KdeScore(X, 1.0)(X))


def test_landmarks_of_equal_orders(spark, monkeypatch):
    """Copies with other keys on both sides: only different numbers meet, and every key has its row."""
    rng = np.random.default_rng(41)
    tables = {"orders": (rng.uniform(1e3, 5e5, 9), "o_orderkey long, o_totalprice double"), "supplier": (rng.uniform(-1e3, 1e4, 5), "s_suppkey long, s_acctbal double")}
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.tile(tables[name][0], 30))], tables[name][1]))
    monkeypatch.setattr(pairwise, "MERGED_PAIRS", 10)
    sides, plain = [], pairwise.weighted_sums
    monkeypatch.setattr(pairwise, "weighted_sums", lambda x, y, *more: sides.append((x.count(), y.count())) or plain(x, y, *more))
    got = catalog.kernel_mean_landmarks(spark, "").orderBy("id").collect()
    want = catalog.PCIMQ(tables["orders"][0][:, None] / 1e5, tables["supplier"][0][:, None] / 5e3).mean(1)
    assert [r.id for r in got] == list(range(270)) and np.allclose([r.mean for r in got], np.tile(want, 30), atol=1e-6)
    assert sides == [(9, 5)]


def test_thinning_takes_large_sums_from_executors(spark, monkeypatch):
    x = np.random.default_rng(40).normal(size=(300, 3))
    p, made, plain = from_arrays(spark, x), [], pairwise.products
    want = solvers.KernelThinning(6, SE).reduce(p).indices()
    monkeypatch.setattr(pairwise, "products", lambda spark, *a: made.append(len(a[0])) or plain(spark, *a))
    for module, name, value in ((solvers, "LOCAL_PAIRS", 10), (greedy, "LATER_PAIRS", 10_000), (greedy, "HALVED", 64)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(catalog, "embeddings", lambda *_: p)
    assert solvers.KernelThinning(6, SE).reduce(p).indices() == want
    assert made[0] == 300 and 192 - 64 in made


def _smooth_sides(rng, n):
    """Points of one, of two and of two coordinates with one always the same, and others that they meet."""
    line, plane = rng.uniform(-2, 5, (n, 1)), np.column_stack((rng.integers(1, 51, n) / 50, rng.uniform(0.9, 1.0, n)))
    flat = np.column_stack((rng.uniform(0, 2, n), np.ones(n)))
    return [(a, np.concatenate((a[: n // 3], a[: n // 3])) + 0.01) for a in (line, plane, flat)]


@pytest.mark.parametrize("kernel", [catalog.PCIMQ, SE, K.SquaredExponential(0.5)])
def test_smooth_kernel_sums_by_nodes(spark, monkeypatch, kernel):
    """All different points: only nodes meet the other side, and means are those of all pairs; equal points have the same mean."""
    monkeypatch.setattr(pairwise, "MERGED_PAIRS", 10)
    monkeypatch.setattr(pairwise, "weighted_sums", None)
    rng = np.random.default_rng(42)
    for x, y in _smooth_sides(rng, 9000):
        x[-1] = x[5]
        w = rng.uniform(size=len(y))
        a, b = from_arrays(spark, x).spread(3), from_arrays(spark, y, w)
        got = [r.mean for r in pairwise.row_mean(a, b, kernel).orderBy("_idx").collect()]
        want = kernel(x, y) @ w / w.sum()
        assert np.allclose(got, want, rtol=1e-13, atol=0) and got[-1] == got[5]
        assert pairwise.mean(a, b, kernel).first().mean == pytest.approx(want.mean(), rel=1e-12)


def test_rough_kernels_are_not_interpolated(spark, monkeypatch):
    """Neither kernels that are not smooth, nor series that do not fall off, nor numbers that are not finite."""
    monkeypatch.setattr(pairwise, "MERGED_PAIRS", 10)
    x = np.random.default_rng(43).uniform(size=(6000, 1))
    few = from_arrays(spark, x[:30])
    assert pairwise._interpolated(from_arrays(spark, x), few, MATERN) is None
    monkeypatch.setattr(K.Matern, "smooth", lambda self: 1.0)
    assert pairwise._interpolated(from_arrays(spark, x), few, MATERN) is None
    assert pairwise._interpolated(from_arrays(spark, x), few, SE) is not None
    for odd in (np.nan, np.inf):
        x[7] = odd
        assert pairwise._interpolated(from_arrays(spark, x), few, SE) is None
    assert pairwise._interpolated(type(few)(few.df.where("false")), few, SE) is None


def test_landmarks_of_different_orders(spark, monkeypatch):
    """No pair of an order and a supplier is evaluated; every order has its mean over all suppliers."""
    rng = np.random.default_rng(44)
    price, balance = rng.uniform(1e3, 5e5, 4000), rng.uniform(-1e3, 1e4, 300)
    tables = {"orders": (price, "o_orderkey long, o_totalprice double"), "supplier": (balance, "s_suppkey long, s_acctbal double")}
    monkeypatch.setattr(catalog, "_read", lambda spark, sf_dir, name: spark.createDataFrame([(i, float(v)) for i, v in enumerate(tables[name][0])], tables[name][1]))
    monkeypatch.setattr(pairwise, "MERGED_PAIRS", 10)
    monkeypatch.setattr(pairwise, "weighted_sums", None)
    got = catalog.kernel_mean_landmarks(spark, "").orderBy("id").collect()
    assert [r.id for r in got] == list(range(4000))
    assert np.allclose([r.mean for r in got], catalog.PCIMQ(price[:, None] / 1e5, balance[:, None] / 5e3).mean(1), atol=6e-7)


def _different_parts(monkeypatch, spark, n=9000):
    """Parts, all different; kernels of pairs come from nodes alone."""
    rng = np.random.default_rng(45)
    x, w = np.column_stack((rng.integers(1, 51, n) / 50, rng.uniform(0.9, 1.0, n))), rng.integers(1, 51, n).astype(float)
    p = from_arrays(spark, x, w)
    monkeypatch.setattr(catalog, "parts", lambda spark, sf_dir, where="true": p if where == "true" else type(p)(p.df.where(where.replace("p_partkey", "_idx"))))
    monkeypatch.setattr(pairwise, "weighted_sums", None)
    return x, w


def test_stein_discrepancy_of_different_parts(spark, monkeypatch):
    x, w = _different_parts(monkeypatch, spark)
    assert catalog.ksd(spark, "").first().value == pytest.approx(np.sqrt(w @ STEIN(x, x) @ w) / w.sum(), abs=1e-6)


def test_stein_kernel_means_of_different_parts(spark, monkeypatch):
    x, w = _different_parts(monkeypatch, spark)
    got = catalog.stein_kernel_mean(spark, "").orderBy("id").collect()
    assert np.allclose([r.mean for r in got], STEIN(x, x) @ w / w.sum(), atol=6e-7) and len(got) == 9000


def test_discrepancy_of_different_parts(spark, monkeypatch):
    x, w = _different_parts(monkeypatch, spark, 24_000)
    a = np.arange(24_000) % 3 == 0
    v = np.where(a, w / w[a].sum(), -w / w[~a].sum())
    assert catalog.mmd_weighted(spark, "").first().value == pytest.approx(np.sqrt(v @ greedy.tiled_product(catalog.PCIMQ, x, x, v)), abs=1e-6)


def test_herding_of_different_parts(spark, monkeypatch):
    x, w = _different_parts(monkeypatch, spark)
    kernel = K.SquaredExponential(0.5, 1.0)
    assert [r.id for r in catalog.herding_weighted(spark, "").orderBy("pos").collect()] == greedy.herding(x, w, 5, kernel).tolist()


def test_herding_of_different_parts_asks_for_no_sums(spark, monkeypatch):
    """Points that are in this process meet nodes here: nothing but the table is asked of the executors."""
    x, w = _different_parts(monkeypatch, spark)
    kernel = K.SquaredExponential(0.5, 1.0)
    for name in ("total_sums", "row_mean", "gramian_row_mean"):
        monkeypatch.setattr(pairwise, name, None)
    assert [r.id for r in catalog.herding_weighted(spark, "").orderBy("pos").collect()] == greedy.herding(x, w, 5, kernel).tolist()
    assert np.allclose(pairwise.smooth_means(x, w, kernel), kernel(x, x) @ w / w.sum(), rtol=1e-13, atol=0)
    assert pairwise.smooth_means(x, w, MATERN) is None and pairwise.smooth_means(x[:300], w[:300], kernel) is None


@pytest.mark.parametrize("kernel", [SE, STEIN, K.Stein(K.PCIMQ(1.0), lambda x: np.abs(x - 0.3))])
def test_smooth_kernel_sums_by_moments(spark, monkeypatch, kernel):
    """No point meets a node: both sides are series, in one cell or several, whatever the score."""
    monkeypatch.setattr(type(kernel), "terms", None)
    monkeypatch.setattr(pairwise, "weighted_sums", None)
    monkeypatch.setattr(pairwise, "SERIES_DEALT", 10_000)
    rng = np.random.default_rng(49)
    for d, n in ((1, 9000), (2, 32_000)):
        x, y = rng.uniform(0, [3.0, 0.1][:d], (n, d)), rng.uniform([-0.5, 0.05][:d], [3.4, 0.12][:d], (n + 7, d))
        w = rng.uniform(size=len(y))
        x[-1] = x[5]
        p, q = from_arrays(spark, x).spread(3), from_arrays(spark, y, w)
        got = [r.mean for r in pairwise.row_mean(p, q, kernel).orderBy("_idx").collect()]
        at = np.r_[0:200, n - 200 : n]
        want = kernel(x[at], y) @ w / w.sum()
        assert np.allclose(np.array(got)[at], want, rtol=1e-12, atol=1e-13) and got[-1] == got[5] and len(got) == n


def test_vectors_that_are_not_finite_or_missing(spark):
    """Of the moments' side they leave the series to its checks; where only a coordinate of x is missing, that row's mean is."""
    x = np.random.default_rng(50).uniform(size=(6000, 1))
    p = from_arrays(spark, x)
    bad = type(p)(p.df.selectExpr("_idx", "if(_idx = 3, array(CAST(NULL AS DOUBLE)), x) AS x", "w"))
    assert pairwise._interpolated(p, bad, SE) is None
    got = [r.mean for r in pairwise._interpolated(bad, p, SE).orderBy("_idx").collect()]
    assert np.isnan(got[3]) and np.isfinite(np.delete(got, 3)).all()
    gone = type(p)(p.df.selectExpr("_idx", "if(_idx = 3, CAST(NULL AS ARRAY<DOUBLE>), x) AS x", "w"))
    assert pairwise._interpolated(gone, p, SE) is None
    with pytest.raises(ValueError, match="null"):
        gone.local()


def test_points_of_one_process_come_by_key(spark):
    """Ascending keys with those that are null first, as Spark sorts; coordinates that are null are NaN."""
    rows = [(5, [1.0, None], 1.0, [2.0]), (None, [3.0, 4.0], None, [1.0]), (-2, [5.0, 6.0], 2.0, [0.0])]
    df = spark.createDataFrame(rows, "_idx long, x array<double>, w double, y array<double>")
    got = Points(df).spread(3).local()
    assert got.idx.tolist() == [None, -2, 5] and np.array_equal(got.x, [[3, 4], [5, 6], [1, np.nan]], equal_nan=True)
    assert np.array_equal(got.w, [np.nan, 2, 1], equal_nan=True) and got.y[:, 0].tolist() == [1, 0, 2]


@pytest.mark.parametrize("kind", ["plain", "repeated", "near"])
def test_kernel_points_by_sums_over_pairs(spark, monkeypatch, kind):
    """The same choice and refinement; few candidates are tried on all points, and of all pairs there are at most eight passes."""
    rng = np.random.default_rng(46)
    x = rng.normal(size=(240, 10)) if kind == "plain" else np.tile(rng.normal(size=(60, 10)), (4, 1))
    x = x + 1e-9 * rng.normal(size=x.shape) if kind == "near" else x
    p = from_arrays(spark, x, None, rng.integers(0, 10, 240))
    monkeypatch.setattr(catalog, "embeddings", lambda *_, **__: p)
    want = [r.id for r in catalog.greedy_kernel_points_refine(spark, "").orderBy("pos").collect()]
    passes, tried, plain, kept = [], [], pairwise.symmetric_products, greedy.PairSums.contenders
    monkeypatch.setattr(solvers, "LOCAL_PAIRS", 10)
    monkeypatch.setattr(pairwise, "symmetric_products", lambda *a: passes.append(a) or plain(*a))
    monkeypatch.setattr(greedy.PairSums, "contenders", lambda *a: tried.append(kept(*a)) or tried[-1])
    assert [r.id for r in catalog.greedy_kernel_points_refine(spark, "").orderBy("pos").collect()] == want
    assert len(passes) <= 8 and len(tried) == 8
    assert kind != "plain" or max(map(len, tried)) <= 3


def test_thinning_halves_parts_on_executors(spark, monkeypatch):
    """The same choice; once halvings are small each part is halved on in a task, none in this process."""
    p = from_arrays(spark, np.random.default_rng(47).normal(size=(300, 3)))
    want = solvers.KernelThinning(6, SE).reduce(p).indices()
    here, plain = [], greedy.kt_half
    for module, name, value in ((solvers, "LOCAL_PAIRS", 10), (greedy, "LATER_PAIRS", 5_000), (greedy, "kt_half", lambda x, *a: here.append(len(x)) or plain(x, *a))):
        monkeypatch.setattr(module, name, value)
    assert solvers.KernelThinning(6, SE).reduce(p).indices() == want
    assert here == [192, 96, 96]


def test_matern_makes_no_spare_tables():
    """Of a tile there are at most three tables at once; the values are those of the polynomial form."""
    import tracemalloc

    x, y = np.random.default_rng(48).uniform(size=(2, 512, 2))
    for kernel in (MATERN, K.Matern(0.7, 1.3, 2), K.Matern(1.0, 1.2, 0)):
        b = np.sqrt(2 * kernel.degree + 1) / kernel.length_scale * np.sqrt(((x[:, None] - y) ** 2).sum(2))
        want = kernel.output_scale**2 * np.exp(-b) * np.polynomial.polynomial.polyval(b, kernel._poly())
        tracemalloc.start()
        got = kernel(x, y)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, want, rtol=1e-14, atol=0) and most < 3.5 * got.nbytes
