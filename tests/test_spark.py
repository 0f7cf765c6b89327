"""Kernel means, samples, solvers and metrics on Spark, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.functions import kernels as K
from siftlake.operators import approx, greedy, metrics, pairwise, score, solvers
from siftlake.plans import catalog
from siftlake.sources.points import Local, from_arrays, points, read, uniform, write

SE = K.SquaredExponential(1.0)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(12)
    x, w = rng.normal(size=(300, 2)), rng.uniform(size=300)
    w[:20] = 0
    return x, w, from_arrays(spark, x, w).spread(3)


def means(df):
    return np.array([r[1] for r in sorted(df.select("_idx", "mean").collect())])


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_row_means_agree(cloud, block_bytes):
    x, w, p = cloud
    want = SE(x, x) @ w / w.sum()
    assert np.allclose(means(pairwise.row_mean(p, p, SE, block_bytes)), want)
    assert np.allclose(means(pairwise.row_mean_sql(p, p, SE, 2)), want)
    assert np.isclose(pairwise.mean(p, p, SE, block_bytes).first()[0], w @ want / w.sum())
    with pytest.raises(ValueError):
        pairwise.row_mean_sql(p, p, SE, 2, limit=10)


@pytest.mark.parametrize("kernel", [K.Linear(0.5, 1), K.Polynomial(1, 1, 2), K.Exponential(), K.Laplacian(), K.PCIMQ(), K.RationalQuadratic(1, 1, 2), K.Matern(1, 1, 2), K.Periodic(), K.Poisson(), K.PCIMQ() * SE + 1, SE**2], ids=str)
def test_sql_form_is_the_numpy_form(cloud, kernel):
    x, w, p = cloud
    assert np.allclose(means(pairwise.row_mean_sql(p, p, kernel, 2)), kernel(x, x) @ w / w.sum())


def test_means_of_eight_and_seven_points(spark):
    x, y = np.column_stack((np.arange(8), np.arange(8) + 1)), np.column_stack((np.arange(7), np.arange(7) + 1))
    wx, wy = np.arange(8.0), np.arange(7.0)
    a, b, k = from_arrays(spark, x, wx), from_arrays(spark, y, wy), SE(x.astype(float), y.astype(float))
    assert np.allclose(means(pairwise.row_mean(a, b, SE)), k @ wy / wy.sum())
    assert np.allclose(means(pairwise.column_mean(a, b, SE)), wx @ k / wx.sum())
    assert np.isclose(pairwise.mean(a, b, SE).first()[0], wx @ k @ wy / wx.sum() / wy.sum())


def test_points(spark, tmp_path):
    p = from_arrays(spark, [1.0, 2.0, 3.0], [1.0, 0.0, 3.0], [5.0, 6.0, 7.0])
    assert p.supervised and p.positive().count() == 2
    assert [r.w for r in sorted(p.normalised().df.select("_idx", "w").collect())] == [0.25, 0, 0.75]
    zero = from_arrays(spark, [1.0, 2.0], 0.0)
    assert {r.w for r in zero.normalised(True).df.collect()} == {0.0} and {r.w for r in zero.normalised().df.collect()} == {None}
    assert [r.x for r in sorted(p.joined().df.select("_idx", "x").collect())] == [[1, 5], [2, 6], [3, 7]]
    with pytest.raises(ValueError):
        p.local(limit=8)
    for kind in ("parquet", "json", "orc"):
        write(p, str(tmp_path / kind), kind)
        assert read(spark, str(tmp_path / kind), "_idx", "x", "w", "y", kind).count() == 3
    df = spark.createDataFrame([(1, 2, 3.0)], "k long, a int, b double")
    assert points(df, "k", ["a", "b"]).df.first().x == [2, 3] and points(df, "k", "a", "b").df.first().w == 3


def test_median_heuristic(cloud):
    x, _, p = cloud
    want = np.sqrt(np.median(K.sq_dist(x, x)[np.triu_indices(300, 1)]) / 2)
    assert np.isclose(pairwise.median_heuristic(p, 2).first()[0], want)


def test_solvers_choose_usable_points_and_keep_order(cloud):
    x, w, p = cloud
    some = [solvers.KernelHerding(8, SE), solvers.RPCholesky(8, SE), solvers.SteinThinning(8, K.PCIMQ()), solvers.KernelThinning(8, SE), solvers.CompressPlusPlus(2, 8, SE), solvers.RandomSample(8, weighted=True), solvers.RandomSample(8, weighted=True, unique=False), solvers.IterativeKernelHerding(8, SE, iterations=2)]
    for solver in some:
        coreset = solver.reduce(p)
        own = coreset.points().df.orderBy("pos").collect()
        assert len(coreset) == 8 and [r.pos for r in own] == list(range(8)) and [r["_idx"] for r in own] == coreset.indices()
        assert np.allclose([r.x for r in own], x[coreset.indices()])
    assert min(solvers.KernelHerding(8, SE).reduce(p).indices()) >= 20
    refined = solvers.KernelHerding(8, SE)
    first = refined.reduce(p)
    assert refined.refine(first).mmd(SE) <= first.mmd(SE) + 1e-9
    for bad in (0, 281):
        with pytest.raises(ValueError):
            solvers.KernelHerding(bad, SE).reduce(p)


def test_weights_lower_the_discrepancy(cloud):
    _, _, p = cloud
    coreset = solvers.RandomSample(10, seed=3).reduce(p)
    before = coreset.mmd(SE)
    assert coreset.solve_weights(SE).mmd(SE) < before
    assert len(coreset.solve_weights(SE, "sbq")) == 10


def test_metrics(spark, cloud):
    x, w, p = cloud
    q = from_arrays(spark, x[50:90])
    assert metrics.mmd(p, p, SE) < 1e-6
    assert np.isclose(metrics.mmd(p, q, SE), greedy.mmd(x, w, x[50:90], np.ones(40), SE))
    a = from_arrays(spark, [-1.0, 0, 1], None, [-1.0, 0, 1])
    b = from_arrays(spark, [1.0, 2], None, [1.0, 2])
    assert np.isclose(metrics.jmmd(a, b, SE, SE, 1) ** 2, _jmmd(a, b))
    one, two, at = from_arrays(spark, [0.0], None, [0.0]), from_arrays(spark, [1.0, 2], None, [1.0, 2]), from_arrays(spark, [1.0])
    half = K.SquaredExponential(1 / np.sqrt(2))
    assert metrics.amcmd(one, two, half, K.Linear(), 0, at) == pytest.approx(1)
    a3, b3 = from_arrays(spark, [-1.0, 0, 1], [2 / 3, 1 / 3, 1], [-1.0, 0, 1]), from_arrays(spark, [1.0, 2], [0.25, 0.75], [1.0, 2])
    e = np.exp(-1)
    assert metrics.jmmd(a3, b3, half, K.Linear(), 1) ** 2 == pytest.approx((37 / 16 + 12 / 16 * e) + (13 / 36 - e**4 / 3) - 2 * (1 / 8 + 6 / 8 * e - e**4 / 12 - 6 / 12 * e**9))
    stein = K.Stein(K.PCIMQ(), np.negative)
    assert np.isclose(metrics.ksd(q, q, stein), np.sqrt(max(stein(x[50:90], x[50:90]).mean(), 0)))
    plain = metrics.ksd(q, q, stein)
    assert metrics.ksd(q, q, stein, laplace=lambda z: np.ones(len(z))) > plain


def _jmmd(a, b):
    x, y = (np.array([r.x[0] for r in p.df.orderBy("_idx").collect()])[:, None] for p in (a, b))
    k = lambda s, t: SE(s, t) ** 2
    return k(x, x).mean() + k(y, y).mean() - 2 * k(x, y).mean()


def test_scores(spark, cloud):
    x, _, p = cloud
    table = {r[0]: r[1] for r in score.kde_score_table(p, p, 0.8, block_bytes=2000).collect()}
    assert np.allclose([table[i] for i in range(300)], score.kde_score(x, 0.8)(x))


def test_score_network_learns_from_all_rows(spark, monkeypatch):
    plain, seen = score.ScoreNetwork._gradients, []
    monkeypatch.setattr(score.ScoreNetwork, "_gradients", lambda self, x, v, weight: seen.append(x) or plain(self, x, v, weight))
    x = np.random.default_rng(6).normal(size=(1500, 2))
    monkeypatch.setattr(catalog, "parts", lambda *_: from_arrays(spark, x).spread(3))
    assert catalog.sliced_score(spark, "").count() == 1500
    rows = np.concatenate(seen)
    assert len(rows) == 3 * 1500 and max(map(len, seen)) == 64
    for k in range(3):
        own = rows[1500 * k : 1500 * k + 1500]
        assert np.array_equal(own[np.lexsort(own.T)], x[np.lexsort(x.T)])
    assert not np.array_equal(rows[:1500], rows[1500:3000])


@pytest.mark.parametrize("kind", [approx.MonteCarlo, approx.ANNchor, approx.Nystrom])
def test_approximate_means(cloud, kind):
    x, w, p = cloud
    got = means(kind(SE, 60, 200).gramian_row_mean(p))
    assert np.abs(got - SE(x, x) @ w / w.sum()).max() < 0.15
    with pytest.raises(ValueError):
        kind(SE, 0)


@pytest.mark.parametrize("farthest", [4096, 7])
def test_annchor_looks_at_all_points(spark, monkeypatch, farthest):
    monkeypatch.setattr(approx, "FARTHEST", farthest, raising=False)
    x = np.random.default_rng(8).normal(size=(500, 2))
    x[[40, 77, 310]] = [[9, 9], [-9, 9], [9, 9]]  # far from all; one of two equal points
    near, chosen = SE(x, x[:1])[:, 0], [0]
    while len(chosen) < 30:
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, SE(x, x[chosen[-1:]])[:, 0])
    got = approx.ANNchor(SE, 30, 40).landmarks(from_arrays(spark, x).spread(3))
    assert {40, 77} <= set(chosen) and np.array_equal(got, x[chosen])
    assert len(approx.ANNchor(SE, 30, 40).landmarks(from_arrays(spark, x[:5]))) == 5


def test_greedy_kernel_points_tries_all_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1]
    p = from_arrays(spark, x, None, y)
    monkeypatch.setattr(catalog, "embeddings", lambda *_, **__: p)
    chosen = []
    for _ in range(4):
        loss = np.full(300, np.inf)
        for j in set(range(300)) - set(chosen):
            own = [*chosen, j]
            fit = SE(x, x[own]) @ np.linalg.solve(SE(x[own], x[own]) + 1e-6 * np.eye(len(own)), y[own])
            loss[j] = fit @ fit - 2 * fit @ y
        chosen.append(int(np.argmin(loss)))
    assert [r.id for r in catalog.greedy_kernel_points(spark, "").orderBy("pos").collect()] == chosen
    monkeypatch.setattr(greedy, "ENTRIES", 2000)
    assert solvers.GreedyKernelPoints(4, SE).reduce(p).indices() == chosen
    few = solvers.GreedyKernelPoints(4, SE, candidate_batch=64).reduce(p).indices()
    assert len(set(few)) == 4 and few != chosen


def test_map_reduce(spark):
    x = np.random.default_rng(3).normal(size=(3000, 2))
    p = from_arrays(spark, x).spread(4)
    got = solvers.MapReduce(solvers.KernelHerding(20, SE), 200).reduce(p)
    chance = np.mean([solvers.RandomSample(20, seed=s).reduce(p).mmd(SE) for s in range(3)])
    assert len(set(got.indices())) == 20 and got.mmd(SE) < chance / 2
    few = solvers.MapReduce(solvers.KernelHerding(20, SE), 200, sample_rows=100).reduce(p)
    assert len(set(few.indices())) == 20
    with pytest.raises(ValueError):
        solvers.MapReduce(solvers.KernelHerding(20, SE), 20)


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_leaves_of_map_reduce_are_bounded(spark, share):
    """Also where most points are equal: no group that one task reduces is much larger than a leaf."""
    x = np.random.default_rng(7).normal(size=(4096, 2))
    x[: int(share * 4096)] = 0.5
    solver = solvers.MapReduce(solvers.KernelHerding(20, SE), 256)
    p = from_arrays(spark, x)
    sizes = [r["count"] for r in solver._parts(p.df, 4096).groupBy("part").count().collect()]
    assert sum(sizes) == 4096 and max(sizes) < 2 * 256
    got = solver.reduce(p)
    assert len(set(got.indices())) == 20
    with pytest.warns(UserWarning):
        solvers.MapReduce(solvers.RPCholesky(20, SE), 256)


def test_many_points_are_evaluated_on_executors(spark, monkeypatch):
    rng = np.random.default_rng(18)
    x, w = rng.normal(size=(200, 2)), rng.uniform(size=200)
    p = from_arrays(spark, x, w, np.sin(x[:, 0])).spread(3)
    some = [solvers.KernelHerding(6, SE), solvers.SteinThinning(6, K.PCIMQ()), solvers.GreedyKernelPoints(4, SE), solvers.IterativeKernelHerding(6, SE, iterations=2)]
    few = [s.reduce(p) for s in some]
    again = [s.refine(c).indices() for s, c in zip(some[:3], few, strict=False)]
    thinned = [solvers.KernelThinning(6, SE), *(solvers.CompressPlusPlus(g, 6, SE) for g in (1, 3))]
    kept = [s.reduce(p).indices() for s in thinned]
    monkeypatch.setattr(solvers, "LOCAL_PAIRS", 10)
    monkeypatch.setattr(solvers, "LOCAL_COMPRESSED", 10)
    assert [s.reduce(p).indices() for s in thinned] == kept
    assert [s.reduce(p).indices() for s in some] == [c.indices() for c in few]
    assert [s.refine(c).indices() for s, c in zip(some[:3], few, strict=False)] == again


def test_draws_with_replacement_are_whole(spark):
    p = from_arrays(spark, np.arange(500.0), np.r_[np.full(250, 1e-12), np.full(250, 0.1)])
    for weighted in (True, False):
        got = solvers.RandomSample(300, seed=5, weighted=weighted, unique=False, bucket_rows=3).reduce(p)
        assert sorted(r.pos for r in got.picks.collect()) == list(range(300))
    batches = solvers.batch_indices(10, 4, 6, seed=1)
    assert batches.shape == (6, 4) and all(len(set(b)) == 4 and max(b) < 10 for b in batches.tolist())
    with pytest.raises(ValueError):
        solvers.batch_indices(3, 4, 1)


@pytest.mark.parametrize("local_rows", [50_000, 60, 5])
def test_recombination_on_executors(spark, cloud, local_rows):
    x, w, p = cloud
    got = solvers.TreeRecombination(mode="explicit").reduce(p, local_rows, most=6 if local_rows == 5 else 512)
    rows = got.points().df.collect()
    assert len(rows) <= 3 and np.isclose(sum(r.w for r in rows), 1)
    assert np.allclose(sum(r.w * np.array(r.x) for r in rows), w @ x / w.sum())
    assert len(solvers.TreeRecombination(mode="implicit").reduce(p)) == 300
    assert len(solvers.Caratheodory().reduce(p)) == 3
    with pytest.raises(ValueError):
        solvers.Caratheodory(mode="other")


def test_uniform_numbers_are_uniform(spark):
    u = np.array([r[0] for r in spark.range(2000).select(uniform(1, "id")).collect()])
    assert abs(u.mean() - 0.5) < 0.03 and u.min() >= 0 and u.max() < 1


def test_merge_reduce_over_a_stream(spark, tmp_path):
    from siftlake.streaming.merge import MergeReduce

    x = np.random.default_rng(5).normal(size=(900, 2))
    for k in range(3):
        from_arrays(spark, x[300 * k : 300 * k + 300]).df.withColumn("_idx", F.col("_idx") + 300 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = MergeReduce(solvers.KernelHerding(15, SE), str(tmp_path / "kept"))
    stream = spark.readStream.schema("_idx long, x array<double>, w double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    kept = Local.of(sink.points(spark).df.toArrow())
    assert len(kept) == 15 and np.isclose(kept.w.sum(), 900)
    assert greedy.mmd(x, np.ones(900), kept.x, kept.w, SE) < 0.15
    # a new driver runs the last batch again, then one more
    later = MergeReduce(solvers.KernelHerding(15, SE), str(tmp_path / "kept"))
    rows = spark.read.schema("_idx long, x array<double>, w double").parquet(str(tmp_path / "in"))
    last = rows.where("_idx >= 600")
    later(last, 2)
    assert np.isclose(Local.of(later.points(spark).df.toArrow()).w.sum(), 900)
    later(last.withColumn("_idx", F.col("_idx") + 300), 3)
    assert np.isclose(Local.of(later.points(spark).df.toArrow()).w.sum(), 1200)


def test_no_machine_local_folder_on_a_cluster():
    from siftlake.sources.tables import folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(Session())


def test_solvers_compare_at_equal_sizes(spark):
    from siftlake.plans.solver_set import discrepancies, solver_set

    rng = np.random.default_rng(20)
    p = from_arrays(spark, rng.uniform(-5, 5, (6, 2))[np.arange(600) % 6] + rng.normal(size=(600, 2)))
    got = discrepancies(p, 2, [16], g=3)
    assert set(got) == set(solver_set(p, 2)) and all(len(v) == 1 for v in got.values())
    assert got["KernelHerding"][16] < got["RandomSample"][16] and got["IterativeHerding"][16] <= got["KernelHerding"][16] + 1e-6
    assert len(solver_set(p, 2, leaf_size=100)["KernelHerding"](16).reduce(p)) == 16
