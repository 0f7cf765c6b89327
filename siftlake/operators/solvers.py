"""Solvers: points to a coreset, in one process or by partitions (MapReduce)."""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.kernels import Kernel, SquaredExponential, Stein
from siftlake.functions.linalg import LeastSquares, MinimalNorm
from siftlake.operators import greedy, pairwise, recombine, weights
from siftlake.operators.metrics import mmd
from siftlake.operators.score import KdeScore, laplace_correction, stein_kernel
from siftlake.sources.points import Local, Points, different, uniform
from siftlake.sources.tables import discard, written

#: Pairs of points that one process evaluates by itself; more are dealt to the executors.
LOCAL_PAIRS = 1 << 26
#: Points that one process compresses by itself.
LOCAL_COMPRESSED = 1 << 16


@dataclass(frozen=True)
class Coreset:
    """Chosen points (pos, _idx, w) of `pre`, in the order of choice; _idx may repeat. few: the picks came through this process."""

    picks: DataFrame
    pre: Points
    few: bool = True

    def points(self) -> Points:
        rest = self.pre.df.drop("w")
        return Points(rest.join(F.broadcast(self.picks) if self.few else self.picks, "_idx").orderBy("pos").select("pos", *[c for c in ("_idx", "x", "w", "y") if c in (*rest.columns, "w")]))

    def __len__(self) -> int:
        return self.picks.count()

    def indices(self) -> list:
        return [r[0] for r in self.picks.orderBy("pos").select("_idx").collect()]

    def compute_metric(self, metric: Callable, *args, **kwargs) -> float:
        return metric(self.pre, self.points(), *args, **kwargs)

    def mmd(self, kernel: Kernel) -> float:
        return mmd(self.pre, self.points(), kernel)

    def solve_weights(self, kernel: Kernel, method: str = "mmd") -> Coreset:
        """New weights: 'mmd' on the simplex, 'sbq' without bounds; kernel means over all points are computed on Spark."""
        own = self.points()
        rows = own.df.orderBy("pos").toArrow()
        local = Local.of(rows)
        distinct = Points(own.df.dropDuplicates(["_idx"]).withColumn("w", F.lit(1.0)))
        at = {r[0]: r[1] for r in pairwise.column_mean(self.pre, distinct, kernel).select("_idx", "mean").collect()}
        mean = np.array([at[i] for i in local.idx.tolist()])
        w = {"mmd": weights.simplex, "sbq": weights.sbq}[method](kernel(local.x, local.x), mean)
        return replace(self, picks=_picks(self.pre, local.idx, w))


def _picks(pre: Points, idx, w=None) -> DataFrame:
    key = dict(pre.df.dtypes)["_idx"]
    w = np.ones(len(idx)) if w is None else w
    if key in ("smallint", "int", "bigint"):  # by Arrow, which starts no Python worker
        idx = pa.array(np.asarray(idx).tolist(), {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[key])
        table = pa.table({"pos": pa.array(range(len(idx)), pa.int32()), "_idx": idx, "w": np.asarray(w, float)})
        return pre.df.sparkSession.createDataFrame(table)
    rows = [(i, v, float(a)) for i, (v, a) in enumerate(zip(np.asarray(idx).tolist(), w, strict=True))]
    return pre.df.sparkSession.createDataFrame(rows, f"pos int, _idx {key}, w double")


class Solver:
    """reduce(points) -> Coreset. choose(local) does the work on points of one process."""

    size: int
    unique: bool = True

    def choose(self, data: Local) -> np.ndarray:
        raise NotImplementedError

    def reduce(self, p: Points) -> Coreset:
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        return Coreset(_picks(p, data.idx[self.choose(data)]), p)

    def _positions(self, data: Local, coreset: Coreset) -> np.ndarray:
        at = {v: i for i, v in enumerate(data.idx.tolist())}
        return np.array([at[v] for v in coreset.indices()])


@dataclass
class RandomSample(Solver):
    """Uniform or weighted, with or without replacement; by hashes of _idx, on all executors."""

    size: int
    seed: int = 0
    weighted: bool = False
    unique: bool = True
    bucket_rows: int = 1_000_000  # rows whose running sum one task makes, with replacement

    def choose(self, data):
        rng = np.random.default_rng(self.seed)
        p = data.w / data.w.sum() if self.weighted else None
        return rng.choice(len(data), self.size, self.unique, p)

    def reduce(self, p: Points) -> Coreset:
        if self.unique:
            u = uniform(self.seed)
            usable = p.df.where("w > 0") if self.weighted else p.df
            order = -F.log(u + F.lit(2.0**-33)) / F.col("w") if self.weighted else u
            idx = [r[0] for r in usable.select("_idx", order.alias("o")).orderBy("o", "_idx").limit(self.size).collect()]
            greedy.check_size(max(len(idx), 1), len(idx), self.size, True)
            return Coreset(_picks(p, idx), p)
        usable = p.df.where("w > 0")
        buckets = max(64, math.ceil(usable.count() / self.bucket_rows))
        rows = usable.select("_idx", F.pmod(F.xxhash64("_idx"), F.lit(buckets)).alias("b"), F.col("w") if self.weighted else F.lit(1.0).alias("w"))
        mass = {r[0]: r[1] for r in rows.groupBy("b").agg(F.sum("w")).collect()}
        keys, rng = sorted(mass), np.random.default_rng(self.seed)
        total = np.array([mass[k] for k in keys])
        of = rng.choice(len(keys), self.size, p=total / total.sum())
        draws = p.df.sparkSession.createDataFrame([(i, keys[k], float(rng.random() * total[k])) for i, k in enumerate(of.tolist())], "pos int, b long, at double")
        drawn = rows.join(F.broadcast(draws.select("b").distinct()), "b", "left_semi")
        order = Window.partitionBy("b").orderBy("_idx")
        upto = drawn.withColumn("hi", F.sum("w").over(order)).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
        upto = upto.withColumn("hi", F.when(F.lead("w").over(order).isNull(), F.lit(math.inf)).otherwise(F.col("hi")))  # rounding loses no draw
        got = upto.join(F.broadcast(draws), "b").where("at >= lo and at < hi").select("pos", "_idx", F.lit(1.0).alias("w"))
        return Coreset(got, p)


@dataclass
class KernelHerding(Solver):
    size: int
    kernel: Kernel
    unique: bool = True
    probabilistic: bool = False
    temperature: float = 1.0
    seed: int = 0

    def _run(self, data: Local, chosen=None, mean=None) -> np.ndarray:
        t = self.temperature if self.probabilistic else None
        noise = greedy.gumbel(self.seed, self.size, len(data)) if self.probabilistic else None
        return greedy.herding(data.x, data.w, self.size, self.kernel, self.unique, chosen, mean, t, noise)

    def choose(self, data):
        return self._run(data)

    def _mean(self, p: Points, data: Local) -> np.ndarray | None:
        """The kernel means of many points, of a smooth kernel from a series, else from the executors; None for few."""
        if len(data) ** 2 <= LOCAL_PAIRS:
            return None
        smooth = pairwise.smooth_means(data.x, data.w, self.kernel)
        if smooth is not None:
            return smooth
        rows = pairwise.gramian_row_mean(p, self.kernel).select("_idx", "mean").orderBy("_idx").toArrow()
        return rows["mean"].to_numpy()

    def reduce(self, p: Points) -> Coreset:
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        return Coreset(_picks(p, data.idx[self._run(data, None, self._mean(p, data))]), p)

    def refine(self, coreset: Coreset) -> Coreset:
        data = coreset.pre.local()
        chosen = self._run(data, self._positions(data, coreset), self._mean(coreset.pre, data))
        return replace(coreset, picks=_picks(coreset.pre, data.idx[chosen]))

    def reduce_iterative(self, p: Points, iterations: int, temperatures: list[float] | None = None) -> Coreset:
        data = p.local()
        schedule = temperatures or ([self.temperature] * iterations if self.probabilistic else None)
        idx = greedy.iterative_herding(data.x, data.w, self.size, self.kernel, iterations, schedule, self.unique, self.seed, self._mean(p, data))
        return Coreset(_picks(p, data.idx[idx]), p)


@dataclass
class IterativeKernelHerding(KernelHerding):
    iterations: int = 1
    temperatures: list[float] | None = None

    def reduce(self, p):
        return self.reduce_iterative(p, self.iterations, self.temperatures)

    def choose(self, data):
        schedule = self.temperatures or ([self.temperature] * self.iterations if self.probabilistic else None)
        return greedy.iterative_herding(data.x, data.w, self.size, self.kernel, self.iterations, schedule, self.unique, self.seed)


@dataclass
class SteinThinning(Solver):
    """The converted kernel is used throughout: for the diagonal, the penalty and the Laplace term."""

    size: int
    kernel: Kernel
    score: Callable | None = None
    unique: bool = True
    regularise: bool = True
    weight: float | None = None
    density: str | float = "scott"

    def _run(self, data: Local, chosen=None, p: Points | None = None):
        """Scores, Laplace terms and log densities once for all points: on the executors if p is given and they are many."""
        kernel = stein_kernel(data.x, self.kernel, self.score)
        d, score, weight = data.x.shape[1], kernel.score, self.weight if self.regularise else 0.0
        weight = 1 / self.size if weight is None else weight
        regularise, density, x, w = self.regularise, self.density, data.x, data.w
        log_density = greedy.KdeLog(x, w, density) if weight else None

        def terms(at):
            laplace, log = np.zeros(len(at)), np.zeros(len(at))
            if regularise and isinstance(score, KdeScore):
                s, laplace = score.with_curvature(at)
            else:
                s = score(at)
                laplace = laplace_correction(score)(at) if regularise else laplace
            if weight:
                log = log_density(at)
            return np.column_stack((s, laplace, log))

        many = p is not None and len(data) ** 2 > LOCAL_PAIRS
        if many:
            first, back = different(x)  # equal points are evaluated once
            rows = p.df if len(first) == len(x) else p.df.groupBy("x").agg(F.min("_idx").alias("_idx"))
            got = pairwise.evaluated(Points(rows).spread(4 * rows.sparkSession.sparkContext.defaultParallelism), terms, d + 2)[back]
        else:
            got = terms(x)
        return greedy.stein(x, w, self.size, kernel, self.unique, weight, got[:, d], density, chosen, np.ascontiguousarray(got[:, :d]), got[:, d + 1])

    def choose(self, data):
        return self._run(data)

    def reduce(self, p: Points) -> Coreset:
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        return Coreset(_picks(p, data.idx[self._run(data, p=p)]), p)

    def refine(self, coreset: Coreset) -> Coreset:
        data = coreset.pre.local()
        return replace(coreset, picks=_picks(coreset.pre, data.idx[self._run(data, self._positions(data, coreset), coreset.pre)]))


@dataclass
class RPCholesky(Solver):
    size: int
    kernel: Kernel
    unique: bool = True
    seed: int | None = 0  # None: the largest residual each time

    def choose(self, data):
        draws = None if self.seed is None else np.random.default_rng(self.seed).random(self.size)
        return greedy.rp_cholesky(data.x, data.w, self.size, self.kernel, self.unique, draws).chosen


@dataclass
class GreedyKernelPoints(Solver):
    size: int
    kernel: Kernel
    reg: float = 1e-6
    unique: bool = True
    candidate_batch: int | None = None
    seed: int = 0
    solver: LeastSquares | None = None
    _kept: tuple | None = field(default=None, init=False, repr=False, compare=False)  # sums of the points last reduced, for refine()

    def _run(self, data: Local, chosen=None, p: Points | None = None) -> np.ndarray:
        """Tries the candidates of a place on the executors if p is given and they are many."""
        if data.y is None:
            raise ValueError("greedy kernel points need responses")
        pool = search = None
        if self.candidate_batch is not None:
            batches = batch_indices(len(data), self.candidate_batch, self.size, self.seed)
            pool = lambda i: batches[i]
        if p is not None and len(data) * min(len(data), self.candidate_batch or len(data)) > LOCAL_PAIRS:
            search = self._search(data, p)
        return greedy.greedy_kernel_points(data.x, data.y, data.w, self.size, self.kernel, self.reg, self.unique, pool, self.solver, chosen, search)

    def _search(self, data: Local, p: Points):
        """The losses of all candidates by sums over all pairs, then those that may be the best as best_point() has them."""
        exact = self._tried(data, p)
        if self.candidate_batch is not None or type(self.solver or MinimalNorm()) is not MinimalNorm or not self.reg >= 1e-8:
            return exact
        mark = (id(p.df), zlib.crc32(data.x.tobytes()), zlib.crc32(data.y.tobytes()))
        if self._kept is None or self._kept[0] != mark:
            self._kept = mark, greedy.PairSums(data.x, data.y[:, 0], self.kernel, lambda v, squares: pairwise.symmetric_products(p.df.sparkSession, data.x, self.kernel, v, squares))
        sums = self._kept[1]

        def search(have, pool):
            return exact(have, sums.contenders(have, pool, self.reg, self.solver or MinimalNorm()))

        return search

    def _tried(self, data: Local, p: Points):
        """Each task tries its share of the candidates on all points, which are broadcast once (their size is checked by local())."""
        spark = p.df.sparkSession
        shared = spark.sparkContext.broadcast((data.x, data.y[:, 0]))
        kernel, reg, solver = self.kernel, self.reg, self.solver or MinimalNorm()
        tasks = 4 * spark.sparkContext.defaultParallelism

        def search(have, pool):
            parts = [pool[i::tasks] for i in range(tasks) if len(pool[i::tasks])]

            def run(batches):
                x, target = shared.value
                for batch in batches:
                    for i in batch.column(0).to_pylist():
                        loss, at = greedy.best_point(x, target, have, parts[i], kernel, reg, solver)
                        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([at], pa.int64())], ["loss", "at"])

            tried = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "loss double, at long")
            return tuple(tried.where("at >= 0").agg(F.min(F.struct("loss", "at")).alias("best")).select("best.*").first())

        return search

    def choose(self, data):
        return self._run(data)

    def reduce(self, p: Points) -> Coreset:
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        return Coreset(_picks(p, data.idx[self._run(data, p=p)]), p)

    def refine(self, coreset: Coreset) -> Coreset:
        """Each place in turn gets the point that is best with all others kept."""
        data = coreset.pre.local()
        return replace(coreset, picks=_picks(coreset.pre, data.idx[self._run(data, self._positions(data, coreset), coreset.pre)]))


def batch_indices(n: int, size: int, batches: int, seed: int = 0) -> np.ndarray:
    """A row of `size` different positions below n for each batch."""
    if not 0 <= size <= n:
        raise ValueError(f"a batch of {size} different ones of {n} positions")
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(n)[:size] for _ in range(batches)]) if batches else np.zeros((0, size), np.int64)


def _root_kernel(kernel: Kernel, given: Kernel | None, d: int) -> Kernel:
    return given or (kernel.sqrt_kernel(d) if isinstance(kernel, SquaredExponential) else kernel)


def later_sums(spark, kernel: Kernel, rest: np.ndarray, run: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For kt_half(): k(rest, run) @ signs, on the executors where it is much."""
    if len(rest) * len(run) <= LOCAL_PAIRS // 4:
        return greedy.tiled_product(kernel, rest, run, signs)
    return pairwise.products(spark, rest, run, kernel, signs)


@dataclass
class KernelThinning(Solver):
    size: int
    kernel: Kernel
    sqrt_kernel: Kernel | None = None
    delta: float | None = None
    seed: int = 0
    unique: bool = True

    def choose(self, data, means=None, later=None, deal=None):
        return greedy.kernel_thinning(data.x, data.w, self.size, self.kernel, _root_kernel(self.kernel, self.sqrt_kernel, data.x.shape[1]), self.delta, self.seed, self.unique, means, later, deal)

    def reduce(self, p: Points) -> Coreset:
        """Of many points kernel means and the sums of large halvings come from the executors; what these leave is halved on, a part in each task."""
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        means = later = deal = None
        if len(data) ** 2 > LOCAL_PAIRS:
            spark, root = p.df.sparkSession, _root_kernel(self.kernel, self.sqrt_kernel, data.x.shape[1])
            sums = pairwise.products(spark, data.x, data.x, self.kernel, np.column_stack((np.ones(len(data)) / len(data), data.w / data.w.sum())))
            means, later = (sums[:, 0], sums[:, 1]), lambda *sides: later_sums(spark, root, *sides)
            deal = lambda parts, halve: self._dealt(spark, data.x, parts, halve)
        return Coreset(_picks(p, data.idx[self.choose(data, means, later, deal)]), p)

    @staticmethod
    def _dealt(spark, x: np.ndarray, parts, halve) -> list[list[np.ndarray]]:
        d = x.shape[1]

        def run(batches):
            for batch in batches:
                for depth, path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    left = halve(np.frombuffer(at).reshape(-1, d), depth, path)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([np.concatenate(left).astype(np.int64).tobytes()], pa.binary())], ["path", "left"])

        rows = pa.table({"depth": pa.array([p[1] for p in parts], pa.int64()), "path": pa.array([p[2] for p in parts], pa.int64()), "x": pa.array([np.ascontiguousarray(x[p[0]]).tobytes() for p in parts], pa.binary())})
        sent = spark.createDataFrame(rows).repartitionByRange(len(parts), "path")
        found = {r.path: np.frombuffer(r.left, np.int64) for r in sent.mapInArrow(run, "path long, left binary").collect()}
        return [np.split(found[path], 2**depth) for _, depth, path in parts]


@dataclass
class CompressPlusPlus(Solver):
    g: int
    size: int
    kernel: Kernel
    sqrt_kernel: Kernel | None = None
    delta: float | None = None
    seed: int = 0
    unique: bool = True

    def choose(self, data, depth: int = 0, nodes=None):
        return greedy.compress(data.x, data.w, self.size, self.g, self.kernel, self._root(data), self.delta, self.seed, depth, nodes)

    def _root(self, data):
        return _root_kernel(self.kernel, self.sqrt_kernel, data.x.shape[1])

    def reduce(self, p: Points) -> Coreset:
        """Of many points the lower levels are reduced on the executors, a node in each task, and only the upper ones here; the choice is the same."""
        data = p.local()
        greedy.check_size(len(data), int((data.w > 0).sum()), self.size, self.unique)
        if len(data) <= LOCAL_COMPRESSED:
            return Coreset(_picks(p, data.idx[self.choose(data)]), p)
        depth = max(1, math.ceil(math.log(p.df.sparkSession.sparkContext.defaultParallelism, 4)))
        return Coreset(_picks(p, data.idx[self.choose(data, depth, self._nodes(data, p))]), p)

    def _nodes(self, data: Local, p: Points):
        spark, d, g, root, seed = p.df.sparkSession, data.x.shape[1], self.g, self._root(data), self.seed

        def nodes(parts, first, delta):
            def run(batches):
                for batch in batches:
                    for path, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        left = greedy.halved(np.frombuffer(x).reshape(-1, d), g, root, delta, seed, path)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([left.tobytes()], pa.binary())], ["path", "left"])

            rows = pa.table({"path": pa.array(range(first, first + len(parts)), pa.int64()), "x": pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())})
            sent = spark.createDataFrame(rows).repartitionByRange(len(parts), "path")
            found = {r.path: np.frombuffer(r.left, np.int64) for r in sent.mapInArrow(run, "path long, left binary").collect()}
            return [found[first + i] for i in range(len(parts))]

        return nodes


@dataclass
class Recombination:
    """Weighted points with the same mean of the test functions (rows -> values); mode 'explicit' keeps non-zero weights only."""

    tests: Callable[[np.ndarray], np.ndarray] | None = None
    mode: str = "implicit-explicit"
    rcond: float | None = None

    def __post_init__(self):
        if self.mode not in ("implicit-explicit", "implicit", "explicit"):
            raise ValueError(f"mode is {self.mode!r}; there are implicit-explicit, implicit and explicit")

    def _values(self, x):
        return x if self.tests is None else np.asarray(self.tests(x)).reshape(len(x), -1)

    def _solve(self, values, w):
        return recombine.caratheodory(values, w, self.rcond)

    def reduce(self, p: Points) -> Coreset:
        data = p.local()
        return self._result(p, data, self._solve(self._values(data.x), data.w / data.w.sum()))

    def _result(self, p, data, w):
        order = np.argsort(w == 0, kind="stable")
        keep = {"implicit": len(w), "explicit": int((w > 0).sum()), "implicit-explicit": min(len(w), self._values(data.x[:1]).shape[1] + 1)}[self.mode]
        order = np.arange(len(w)) if self.mode == "implicit" else order[: max(keep, int((w > 0).sum()))]
        return Coreset(_picks(p, data.idx[order], w[order]), p)


class Caratheodory(Recombination):
    """By null directions of all points at once: one dense SVD, so the points must fit in one process."""


@dataclass
class TreeRecombination(Recombination):
    """By centroids: each round adds up weights and test values of hashed groups on all executors and solves the groups' small system.

    A round keeps the points of one group in `factor`, at least; as many as MOST groups make one round enough where
    that can be. The rows that a round keeps are written, so none is evaluated twice.
    """

    factor: int = 2

    def reduce(self, p: Points, local_rows: int = 50_000, most: int = 512) -> Coreset:
        if self.factor < 2:
            raise ValueError(f"factor is {self.factor}; groups of points shrink from a factor of 2 on")
        tests = self.tests
        rows = p.df.where("w > 0").select("_idx", "x", "w")
        first = rows.limit(1).toArrow()
        if not first.num_rows:
            raise ValueError("no point has a positive weight")
        q = self._values(Local.of(first).x).shape[1]
        n, total, turn, before = None, 1.0, 0, None
        while n is None or n > local_rows:
            # the first round does not know the number of points, so it takes as many groups as it may
            need = most if n is None else 2 * math.ceil(n / local_rows) * (q + 1)
            groups = max(self.factor * (q + 1), min(most, need))
            group = F.pmod(F.xxhash64("_idx", F.lit(turn)), F.lit(groups)).cast("int")

            def add(batches, groups=groups):
                mass, value, count = np.zeros(groups), np.zeros((groups, q)), np.zeros(groups, np.int64)
                for batch in batches:
                    if batch.num_rows:
                        of, x, w = np.asarray(batch.column(0)), pairwise.matrix(batch.column(1)), np.asarray(batch.column(2))
                        v = x if tests is None else np.asarray(tests(x)).reshape(len(x), -1)
                        count += np.bincount(of, minlength=groups)
                        mass += np.bincount(of, w, groups)
                        for j in range(q):
                            value[:, j] += np.bincount(of, v[:, j] * w, groups)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array(mass[at]), pa.array(list(value[at]), pa.list_(pa.float64()))], ["g", "n", "mass", "value"])

            sums = rows.select(group.alias("g"), "x", "w").mapInArrow(add, "g int, n long, mass double, value array<double>")
            sums = sums.groupBy("g").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), *[F.sum(F.col("value")[i]).alias(f"v{i}") for i in range(q)]).collect()
            if n is None:
                n, total = sum(r.n for r in sums), sum(r.mass for r in sums)
                if n <= local_rows:
                    break
            mass = np.array([r.mass for r in sums])
            centre = np.array([[r[f"v{i}"] for i in range(q)] for r in sums]) / mass[:, None]
            kept = recombine.caratheodory(centre, mass, self.rcond)
            scale = {r.g: float(k / m) for r, k, m in zip(sums, kept, mass, strict=True) if k > 0}
            left = sum(r.n for r in sums if r.g in scale)
            if left >= n:
                break
            own = F.create_map(*[F.lit(v) for pair in scale.items() for v in pair])
            old, before = before, written(rows.withColumn("g", group).where(F.col("g").isin(list(scale))).select("_idx", "x", (F.col("w") * own[F.col("g")]).alias("w")), "recombined")
            if old is not None:
                discard(old)
            rows, n, turn = before, left, turn + 1
        data = Points(rows).local()
        if before is not None:
            discard(before)
        w = recombine.tree(self._values(data.x), data.w / total, self.factor, self.rcond)
        if self.mode == "implicit":
            kept = Points(p.df.sparkSession.createDataFrame(list(zip(data.idx.tolist(), w.tolist(), strict=True)), f"_idx {dict(p.df.dtypes)['_idx']}, w double")).df
            picked = p.df.select("_idx").join(F.broadcast(kept), "_idx", "left").orderBy("_idx")  # local_rows rows at most
            return Coreset(picked.select(F.monotonically_increasing_id().alias("pos"), "_idx", F.coalesce("w", F.lit(0.0)).alias("w")), p, few=False)
        return self._result(p, data, w)


def leaves(n: int, leaf_size: int) -> int:
    """How many parts MapReduce makes of n points."""
    half = max(1, leaf_size // 2)
    return 2 ** max(0, int(math.floor(math.log2((n - 1) / half)))) if n > 1 and n - 1 >= half else 1


def split_tree(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, threshold) of the inner nodes of a space-splitting tree, level by level: the widest dimension, at the median."""
    nodes, parts = [], [x]
    for _ in range(depth):
        below = []
        for part in parts:
            d = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            order = np.sort(part[:, d]) if len(part) else np.zeros(1)
            at = float(order[(len(order) - 1) // 2])
            nodes.append((d, at))
            below += [part[part[:, d] <= at], part[part[:, d] > at]]
        parts = below
    return nodes


def place(x: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each row."""
    at, d, cut = np.zeros(len(x), np.int64), np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (x[np.arange(len(x)), d[at]] > cut[at])
    return at - len(nodes)


@dataclass
class MapReduce:
    """Reduces each part of a space-splitting tree with `base`, then the union of what is left, until one part remains.

    The tree is fitted on a sample of about sample_rows points and has at most one leaf for 32 of them. The points of
    each leaf are counted, and a leaf with more than leaf_size of them (few leaves, or many equal points) is dealt on
    by hashes of _idx, so a part is one group of about leaf_size rows. The points are written before each round and
    read three times: for the sample, the counts and the parts. Weights of chosen points are 1, as the base solver
    leaves them.
    """

    base: Solver
    leaf_size: int
    sample_rows: int = 100_000
    warn: bool = field(default=True, repr=False)

    def __post_init__(self):
        if self.leaf_size <= self.base.size:
            raise ValueError(f"leaf_size is {self.leaf_size}; a leaf holds more than the {self.base.size} points that are chosen of it")
        if self.warn and not isinstance(self.base, (KernelHerding, SteinThinning)):
            warnings.warn(f"{type(self.base).__name__} does not look at points in the order of a tree; parts of different sizes count alike", stacklevel=2)

    def reduce(self, p: Points) -> Coreset:
        columns = [c for c in ("_idx", "x", "w", "y") if c in p.df.columns]
        now = written(p.df.select(*columns), "points")
        n = now.count()
        while n > self.leaf_size:
            parts = self._parts(now, n)
            after = written(self._shrunk(parts, columns, now.schema), "points")
            left = after.count()
            discard(now)
            now = after
            if left >= n:
                break
            n = left
        last = self.base.reduce(Points(now))
        picks = _picks(p, last.indices())
        discard(now)
        return Coreset(picks, p)

    def _parts(self, now: DataFrame, n: int) -> DataFrame:
        """now with its part."""
        spark = now.sparkSession
        share = min(1.0, 1.2 * self.sample_rows / n)
        sample = now.where(uniform(0) < share).select("_idx", "x", "w").toArrow() if share < 1 else now.select("_idx", "x", "w").toArrow()
        x = Local.of(sample).x
        depth = max(0, min(int(math.log2(max(2, leaves(n, self.leaf_size)))), int(math.log2(max(1, len(x) // 32)))))
        shared, at = spark.sparkContext.broadcast(split_tree(x, depth)), now.columns.index("x")

        def leaf_of(batch):
            rows = pairwise.matrix(batch.column(at))
            return place(rows, shared.value) if shared.value else np.zeros(len(rows), np.int64)

        def count(batches):
            total = np.zeros(1 << depth, np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += np.bincount(leaf_of(batch), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["leaf", "n"])

        sizes = now.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
        salts = np.ones(1 << depth, np.int64)
        for r in sizes:
            salts[r.leaf] = max(1, math.ceil(r.n / self.leaf_size))
        first = np.cumsum(salts) - salts
        table = spark.sparkContext.broadcast((first, salts))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)

        def tag(batches):
            for batch in batches:
                if batch.num_rows:
                    leaf = leaf_of(batch)
                    first, salts = table.value
                    part = first[leaf] + batch.column(len(batch.columns) - 1).to_numpy() % salts[leaf]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(part)], [*batch.schema.names[:-1], "part"])

        hashed = now.withColumn("h", F.xxhash64("_idx").bitwiseAND(F.lit((1 << 62) - 1)))
        return hashed.mapInArrow(tag, schema + ", part long")

    def _shrunk(self, parts: DataFrame, columns: list[str], schema) -> DataFrame:
        base = self.base

        def shrink(table: pa.Table) -> pa.Table:
            table = table.select(columns).sort_by("_idx").combine_chunks()
            w = table["w"].to_numpy()
            if int((w > 0).sum()) <= base.size:
                return table
            y = pairwise.matrix(table["y"]) if "y" in columns else None
            data = Local(np.arange(len(w)), pairwise.matrix(table["x"]), w, y)
            kept = table.take(pa.array(replace(base).choose(data)))
            return kept.set_column(columns.index("w"), "w", pa.array(np.ones(len(kept))))

        return parts.groupBy("part").applyInArrow(shrink, schema)
