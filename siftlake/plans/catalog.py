"""Registered queries over the test tables, and DuckDB SQL for those that it can express.

Queries run numpy blocks on Spark (or the solvers); their SQL computes the same from kernels' SQL form in DuckDB.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import kernels as K
from siftlake.functions.linalg import MinimalNorm, RandomisedEigen
from siftlake.operators import approx, metrics, pairwise, score, solvers
from siftlake.operators.greedy import kt_half
from siftlake.sources.points import Points, points, uniform

KERNELS = {
    "linear": K.Linear(0.5, 1.0),
    "polynomial": K.Polynomial(0.5, 1.0, 3),
    "exponential": K.Exponential(1.0, 1.0),
    "laplacian": K.Laplacian(2.0, 1.0),
    "squared_exponential": K.SquaredExponential(1.0, 1.0),
    "pcimq": K.PCIMQ(1.0, 1.5),
    "rational_quadratic": K.RationalQuadratic(1.0, 1.0, 1.5),
    "matern": K.Matern(1.0, 1.2, 2),
    "periodic": K.Periodic(1.0, 1.0, 3.0),
    "locally_periodic": K.locally_periodic(K.Periodic(1.0, 1.0, 3.0), K.SquaredExponential(1.0, 1.0)),
    "poisson": K.Poisson(0.5, 1.0),
    "sum": K.SquaredExponential(1.0, 1.0) + K.Linear(0.5, 0.0) + 1,
    "product": K.PCIMQ(1.0, 1.0) * K.Linear(0.5, 1.0) * 2,
    "power": K.PCIMQ(1.0, 1.0) ** 3,
    "square_root": K.SquaredExponential(1.0, 1.0).sqrt_kernel(2),
}
SE, PCIMQ = K.SquaredExponential(1.0, 1.0), K.PCIMQ(1.0, 1.0)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir, where: str = "true", **more) -> Points:
    rows = points(_read(spark, sf_dir, "embeddings").where(where), "vec_id", "embedding", **more)
    return rows.spread(spark.sparkContext.defaultParallelism)


def parts(spark, sf_dir, where: str = "true", weight="p_size", **more) -> Points:
    df = _read(spark, sf_dir, "part").where(where)
    return points(df, "p_partkey", [F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0], weight, **more).spread(spark.sparkContext.defaultParallelism)


def suppliers(spark, sf_dir, where: str = "true", **more) -> Points:
    return points(_read(spark, sf_dir, "supplier").where(where), "s_suppkey", [F.col("s_acctbal") / 5000.0], **more)


# SQL over (i, x, w) in DuckDB
E = "SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x, 1.0::DOUBLE AS w FROM embeddings"
P = "SELECT p_partkey AS i, [p_size / 50.0::DOUBLE, p_retailprice / 1000.0::DOUBLE] AS x, p_size::DOUBLE AS w FROM part"
S = "SELECT s_suppkey AS i, [s_acctbal / 5000.0::DOUBLE] AS x, 1.0::DOUBLE AS w FROM supplier"
D = ("list_distance(a.x, b.x)", "list_sum(list_transform(range(1, len(a.x) + 1), lambda j: abs(a.x[j] - b.x[j])))", "list_inner_product(a.x, b.x)")
PAIR = ("sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2))", "abs(a.x[1] - b.x[1]) + abs(a.x[2] - b.x[2])", "(a.x[1] * b.x[1] + a.x[2] * b.x[2])")


def _kernel_query(kernel, data):
    def run(spark, sf_dir):
        p = data(spark, sf_dir)
        return pairwise.gramian_row_mean(p, kernel).select(F.col("_idx").alias("id"), F.round("mean", 6).alias("mean"))

    return run


def _kernel_sql(kernel, rows, dist):
    return f"WITH p AS ({rows}) SELECT a.i AS id, round(sum(b.w * {kernel.sql(*dist)}) / sum(b.w), 6) AS mean FROM p a, p b GROUP BY a.i"


QUERIES, ORACLES = {}, {}
for _name, _kernel in KERNELS.items():
    QUERIES[f"kernel_mean_{_name}"] = _kernel_query(_kernel, embeddings)
    ORACLES[f"kernel_mean_{_name}"] = _kernel_sql(_kernel, E, D)
QUERIES["kernel_mean_weighted"] = _kernel_query(K.Matern(1.0, 1.0, 1), parts)
ORACLES["kernel_mean_weighted"] = _kernel_sql(K.Matern(1.0, 1.0, 1), P, PAIR)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _one(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), 6) for v in values.values())], ", ".join(f"{n} double" for n in values))


_ALONG = "list_distance(a.x, b.x)"


@query("kernel_elementwise", f"""WITH p AS ({E}), k AS (SELECT a.i, a.x AS ax, b.x AS bx, len(a.x) AS d, pow({_ALONG}, 2) AS r2, {SE.sql(*D)} AS k FROM p a JOIN p b ON b.i = a.i + 1)
SELECT i AS id, round(k, 6) AS k, round((bx[1] - ax[1]) * k, 6) AS gx0, round((ax[d] - bx[d]) * k, 6) AS gy_last, round((d - r2) * k, 6) AS divergence FROM k""")
def kernel_elementwise(spark, sf_dir):
    """Kernel and derivatives of each embedding and the one with the next number."""
    df = _read(spark, sf_dir, "embeddings")
    pairs = df.select("vec_id", F.col("embedding").alias("a")).join(df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    got = pairwise.elementwise(pairs, "vec_id", "a", "b", SE)
    return got.select(F.col("vec_id").alias("id"), F.round("k", 6).alias("k"), F.round(F.col("grad_x")[0], 6).alias("gx0"), F.round(F.element_at("grad_y", -1), 6).alias("gy_last"), F.round("divergence", 6).alias("divergence"))


@query("kernel_mean_all", f"WITH p AS ({P}) SELECT round(sum(a.w * b.w * {SE.sql(*PAIR)}) / sum(a.w * b.w), 6) AS mean FROM p a, p b")
def kernel_mean_all(spark, sf_dir):
    p = parts(spark, sf_dir)
    return pairwise.mean(p, p, SE).select(F.round("mean", 6).alias("mean"))


ORDERS_SQL = "SELECT o_orderkey AS i, [o_totalprice / 100000.0::DOUBLE] AS x FROM orders"


@query("kernel_mean_landmarks", f"WITH a AS ({ORDERS_SQL}), b AS ({S}) SELECT a.i AS id, round(avg({K.PCIMQ(1.0, 1.0).sql('abs(a.x[1] - b.x[1])', '0', '0')}), 6) AS mean FROM a, b GROUP BY a.i")
def kernel_mean_landmarks(spark, sf_dir):
    rows = points(_read(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_totalprice") / 100000.0])
    return pairwise.row_mean(rows, suppliers(spark, sf_dir), K.PCIMQ(1.0, 1.0)).select(F.col("_idx").alias("id"), F.round("mean", 6).alias("mean"))


@query("median_heuristic", f"WITH p AS ({S}) SELECT round(sqrt(median(pow(a.x[1] - b.x[1], 2)) / 2), 6) AS length_scale FROM p a, p b WHERE a.i < b.i")
def median_heuristic(spark, sf_dir):
    return pairwise.median_heuristic(suppliers(spark, sf_dir), 1).select(F.round("length_scale", 6).alias("length_scale"))


@query("normalise", f"WITH p AS ({P}) SELECT i AS id, round(w / sum(w) OVER (), 12) AS w FROM p")
def normalise(spark, sf_dir):
    return parts(spark, sf_dir).normalised().df.select(F.col("_idx").alias("id"), F.round("w", 12).alias("w"))


def _mmd_sql(kernel: str, x: str, y: str) -> str:
    def term(a, b):
        return f"(SELECT sum(a.w * b.w * {kernel}) / sum(a.w * b.w) FROM {a} a, {b} b)"

    return f"WITH s AS ({x}), t AS ({y}) SELECT round(sqrt(greatest(0, {term('s', 's')} + {term('t', 't')} - 2 * {term('s', 't')})), 6) AS value"


@query("mmd", _mmd_sql(SE.sql(*D), f"SELECT * FROM ({E}) WHERE i % 2 = 0", f"SELECT * FROM ({E}) WHERE i % 2 = 1"))
def mmd(spark, sf_dir):
    return _one(spark, value=metrics.mmd(embeddings(spark, sf_dir, "vec_id % 2 = 0"), embeddings(spark, sf_dir, "vec_id % 2 = 1"), SE))


@query("mmd_weighted", _mmd_sql(PCIMQ.sql(*PAIR), f"SELECT * FROM ({P}) WHERE i % 3 = 0", f"SELECT * FROM ({P}) WHERE i % 3 <> 0"))
def mmd_weighted(spark, sf_dir):
    return _one(spark, value=metrics.mmd(parts(spark, sf_dir, "p_partkey % 3 = 0"), parts(spark, sf_dir, "p_partkey % 3 <> 0"), PCIMQ))


_L = "SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS x, label::DOUBLE AS y, 1.0::DOUBLE AS w FROM embeddings"


@query("jmmd", _mmd_sql(f"{SE.sql(*D)} * {SE.sql('abs(a.y - b.y)', '0', '0')}", f"SELECT * FROM ({_L}) WHERE i % 2 = 0", f"SELECT * FROM ({_L}) WHERE i % 2 = 1"))
def jmmd(spark, sf_dir):
    return _one(spark, value=metrics.jmmd(embeddings(spark, sf_dir, "vec_id % 2 = 0", y="label"), embeddings(spark, sf_dir, "vec_id % 2 = 1", y="label"), SE, SE, 64))


def gaussian_score(x: np.ndarray) -> np.ndarray:
    return -x


# PCIMQ Stein kernel for the score -x: slope = phi'/r, second = phi''
_R2 = "(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2))"
_SLOPE = f"(-0.5 * pow(1 + {_R2} / 2, -1.5))"
_STEIN = f"(-({_SLOPE} + 0.75 * {_R2} * pow(1 + {_R2} / 2, -2.5) + {_SLOPE}) + {_SLOPE} * {_R2} + pow(1 + {_R2} / 2, -0.5) * {PAIR[2]})"


@query("stein_kernel_mean", f"WITH p AS ({P}) SELECT a.i AS id, round(sum(b.w * {_STEIN}) / sum(b.w), 6) AS mean FROM p a, p b GROUP BY a.i")
def stein_kernel_mean(spark, sf_dir):
    return _kernel_query(K.Stein(PCIMQ, gaussian_score), parts)(spark, sf_dir)


@query("ksd", f"WITH p AS ({P}) SELECT round(sqrt(greatest(0, sum(a.w * b.w * {_STEIN}) / sum(a.w * b.w))), 6) AS value FROM p a, p b")
def ksd(spark, sf_dir):
    p = parts(spark, sf_dir)
    return _one(spark, value=metrics.ksd(p, p, K.Stein(PCIMQ, gaussian_score)))


@query("kde_score", f"WITH p AS ({S}) SELECT a.i AS id, round((sum(b.x[1] * {SE.sql('abs(a.x[1] - b.x[1])', '0', '0')}) / sum({SE.sql('abs(a.x[1] - b.x[1])', '0', '0')})) - any_value(a.x[1]), 6) AS score FROM p a, p b GROUP BY a.i")
def kde_score(spark, sf_dir):
    p = suppliers(spark, sf_dir)
    return score.kde_score_table(p, p, 1.0).select(F.col("_idx").alias("id"), F.round(F.col("score")[0], 6).alias("score"))


def _picked(coreset: solvers.Coreset) -> DataFrame:
    return coreset.picks.select("pos", F.col("_idx").alias("id"))


def _greedy_sql(rows: str, kernel: str, score_: str, m: int, best: str, refined: bool = False) -> str:
    """A chain of steps: each scores all points but the chosen and takes the first of the best; refined: then each place again, with all others kept."""
    steps = [f"p AS MATERIALIZED ({rows})", f"k AS MATERIALIZED (SELECT a.i, sum(b.w * {kernel}) / sum(b.w) AS mean, any_value(CASE WHEN a.i = b.i THEN {kernel} END) AS own FROM p a, p b GROUP BY a.i)"]
    for s in range(m):
        before = " UNION ALL ".join(f"SELECT i FROM c{t}" for t in range(s))
        penalty = f"(SELECT a.i, sum({kernel}) AS pen FROM p a, p b WHERE b.i IN ({before}) GROUP BY a.i)" if s else "(SELECT i, 0.0 AS pen FROM p)"
        out = f"WHERE k.i NOT IN ({before})" if s else ""
        steps.append(f"c{s} AS MATERIALIZED (SELECT {s} AS pos, k.i FROM k JOIN {penalty} q ON k.i = q.i {out} ORDER BY {score_.format(n=s + 1)} {best}, k.i LIMIT 1)")
    for s in range(m if refined else 0):
        others = " UNION ALL ".join([*(f"SELECT i FROM r{t}" for t in range(s)), *(f"SELECT i FROM c{t}" for t in range(s + 1, m))])
        penalty = f"(SELECT a.i, sum({kernel}) AS pen FROM p a, p b WHERE b.i IN ({others}) GROUP BY a.i)"
        steps.append(f"r{s} AS MATERIALIZED (SELECT {s} AS pos, k.i FROM k JOIN {penalty} q ON k.i = q.i WHERE k.i NOT IN ({others}) ORDER BY {score_.format(n=m)} {best}, k.i LIMIT 1)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT pos, i AS id FROM {'r' if refined else 'c'}{s}" for s in range(m))


@query("herding", _greedy_sql(E, SE.sql(*D), "k.mean - q.pen / {n}", 6, "DESC"))
def herding(spark, sf_dir):
    return _picked(solvers.KernelHerding(6, SE).reduce(embeddings(spark, sf_dir)))


@query("herding_weighted", _greedy_sql(P, K.SquaredExponential(0.5, 1.0).sql(*PAIR), "k.mean - q.pen / {n}", 5, "DESC"))
def herding_weighted(spark, sf_dir):
    return _picked(solvers.KernelHerding(5, K.SquaredExponential(0.5, 1.0)).reduce(parts(spark, sf_dir)))


@query("stein_thinning", _greedy_sql(P, _STEIN, "k.own + 2 * q.pen", 4, "ASC"))
def stein_thinning(spark, sf_dir):
    return _picked(solvers.SteinThinning(4, K.Stein(PCIMQ, gaussian_score), regularise=False).reduce(parts(spark, sf_dir)))


# each step takes the largest residual of the diagonal, the last point on ties
_K0 = K.SquaredExponential(0.5, 1.0).sql(*PAIR)
_CHOL = f"""WITH p AS MATERIALIZED ({P}), c0 AS (SELECT max(i) AS i FROM p),
f0 AS MATERIALIZED (SELECT a.i, {_K0} AS f FROM p a, p b WHERE b.i = (SELECT i FROM c0)),
r1 AS MATERIALIZED (SELECT i, greatest(0, 1 - f * f) AS r FROM f0), c1 AS MATERIALIZED (SELECT i FROM r1 ORDER BY r DESC, i DESC LIMIT 1),
f1 AS MATERIALIZED (SELECT a.i, ({_K0} - f0.f * g.f) / sqrt(1 - g.f * g.f) AS f FROM p a JOIN f0 ON f0.i = a.i, p b JOIN f0 g ON g.i = b.i WHERE b.i = (SELECT i FROM c1)),
c2 AS (SELECT r1.i FROM r1 JOIN f1 USING (i) ORDER BY round(greatest(0, r - f * f), 12) DESC, r1.i DESC LIMIT 1)
SELECT 0 AS pos, i AS id FROM c0 UNION ALL SELECT 1, i FROM c1 UNION ALL SELECT 2, i FROM c2"""


@query("rp_cholesky", _CHOL)
def rp_cholesky(spark, sf_dir):
    return _picked(solvers.RPCholesky(3, K.SquaredExponential(0.5, 1.0), seed=None).reduce(parts(spark, sf_dir)))


def _uniform_sql(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}-' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_U = _uniform_sql(7)


@query("random_sample", f"WITH p AS ({E}), s AS (SELECT i, row_number() OVER (ORDER BY {_U}, i) - 1 AS pos FROM p) SELECT CAST(pos AS INT) AS pos, i AS id FROM s WHERE pos < 20")
def random_sample(spark, sf_dir):
    return _picked(solvers.RandomSample(20, seed=7).reduce(embeddings(spark, sf_dir)))


@query("random_sample_weighted", f"WITH p AS ({P}), s AS (SELECT i, row_number() OVER (ORDER BY -ln({_U} + pow(2.0, -33)) / w, i) - 1 AS pos FROM p WHERE w > 0) SELECT CAST(pos AS INT) AS pos, i AS id FROM s WHERE pos < 20")
def random_sample_weighted(spark, sf_dir):
    return _picked(solvers.RandomSample(20, seed=7, weighted=True).reduce(parts(spark, sf_dir)))


@query("uniform_numbers", f"WITH p AS ({E}) SELECT i AS id, {_U} AS u FROM p")
def uniform_numbers(spark, sf_dir):
    return embeddings(spark, sf_dir).df.select(F.col("_idx").alias("id"), uniform(7).alias("u"))


#: Columns and digits of their means; whole quantities are divided by round numbers of rows, so their means end in 5 at fewer digits.
_LINE = {"l_quantity": 6, "l_extendedprice": 4, "l_discount": 4, "l_tax": 4}


@query("tree_recombination", f"SELECT {', '.join(f'round(avg({c}), {n}) AS {c}' for c, n in _LINE.items())}, 1.0::DOUBLE AS total, true AS few FROM lineitem")
def tree_recombination(spark, sf_dir):
    """The weighted mean of at most five of all rows is the mean of all."""
    df = _read(spark, sf_dir, "lineitem")
    p = points(df.withColumn("key", F.xxhash64(*df.columns)), "key", list(_LINE)).spread(spark.sparkContext.defaultParallelism)
    got = solvers.TreeRecombination(mode="explicit").reduce(p).points().df
    return got.agg(*[F.round(F.sum(F.col("w") * F.col("x")[i]), n).alias(c) for i, (c, n) in enumerate(_LINE.items())], F.round(F.sum("w"), 6).alias("total"), (F.count("*") <= 5).alias("few"))


@query("caratheodory", f"SELECT round(avg(x[1]), 6) AS x0, 1.0::DOUBLE AS total, true AS few FROM ({S})")
def caratheodory(spark, sf_dir):
    """The weighted mean of at most two suppliers is the mean of all."""
    got = solvers.Caratheodory(mode="explicit").reduce(suppliers(spark, sf_dir)).points().df
    return got.agg(F.round(F.sum(F.col("w") * F.col("x")[0]), 6).alias("x0"), F.round(F.sum("w"), 6).alias("total"), (F.count("*") <= 2).alias("few"))


@query("tree_recombination_weighted", "SELECT round(sum(p_size * p_size) / sum(p_size) / 50.0, 6) AS x0, round(sum(p_size * p_retailprice) / sum(p_size) / 1000.0, 6) AS x1, 1.0::DOUBLE AS total, true AS few FROM part")
def tree_recombination_weighted(spark, sf_dir):
    p = parts(spark, sf_dir)
    got = solvers.TreeRecombination(mode="explicit", factor=3).reduce(p, local_rows=100).points().df
    return got.agg(*[F.round(F.sum(F.col("w") * F.col("x")[i]), 6).alias(f"x{i}") for i in range(2)], F.round(F.sum("w"), 6).alias("total"), (F.count("*") <= 3).alias("few"))


# two herded points, and the 2 x 2 system of their kernel and means
_TWO = _greedy_sql(E, SE.sql(*D), "k.mean - q.pen / {n}", 2, "DESC")
_SYSTEM = _TWO.replace(" SELECT pos, i AS id FROM c0 UNION ALL SELECT pos, i AS id FROM c1", f", z AS (SELECT (SELECT mean FROM k WHERE i = (SELECT i FROM c0)) AS z0, (SELECT mean FROM k WHERE i = (SELECT i FROM c1)) AS z1, (SELECT {SE.sql(*D)} FROM p a, p b WHERE a.i = (SELECT i FROM c0) AND b.i = (SELECT i FROM c1)) AS c)")


def _weights(method):
    def run(spark, sf_dir):
        return solvers.KernelHerding(2, SE).reduce(embeddings(spark, sf_dir)).solve_weights(SE, method).picks.select("pos", F.round("w", 6).alias("w"))

    return run


query("sbq_weights", _SYSTEM + " SELECT 0 AS pos, round((z0 - c * z1) / (1 - c * c), 6) AS w FROM z UNION ALL SELECT 1, round((z1 - c * z0) / (1 - c * c), 6) FROM z")(_weights("sbq"))
_W0 = "greatest(0, least(1, 0.5 + (z0 - z1) / (2 * (1 - c))))"
query("mmd_weights", _SYSTEM + f" SELECT 0 AS pos, round({_W0}, 6) AS w FROM z UNION ALL SELECT 1, round(1 - {_W0}, 6) FROM z")(_weights("mmd"))


@query("herding_refine", _greedy_sql(E, SE.sql(*D), "k.mean - q.pen / {n}", 10, "DESC", refined=True))
def herding_refine(spark, sf_dir):
    solver, p = solvers.KernelHerding(10, SE), embeddings(spark, sf_dir)
    return _picked(solver.refine(solver.reduce(p)))


@query("herding_iterative_greedy", _greedy_sql(E, SE.sql(*D), "k.mean - q.pen / {n}", 5, "DESC", refined=True))
def herding_iterative_greedy(spark, sf_dir):
    """Two rounds without chance: the second refines the first."""
    return _picked(solvers.IterativeKernelHerding(5, SE, iterations=2).reduce(embeddings(spark, sf_dir)))


# what follows without SQL has no such form; tests hold it against goldens and invariants
@query("herding_iterative")
def herding_iterative(spark, sf_dir):
    return _picked(solvers.KernelHerding(10, SE, probabilistic=True, temperature=0.01).reduce_iterative(embeddings(spark, sf_dir), 3))


def _regularised_stein_sql(m: int) -> str:
    """Scores and curvature of a Gaussian density of width 1, log densities of a weighted one with the data's covariance, then the steps."""
    g = f"exp(-{_R2} / 2)"
    moments = ", ".join(f"sum(b.x[{i}] * {g}) / sum({g}) AS m{i}, sum(b.x[{i}] * b.x[{i}] * {g}) / sum({g}) AS q{i}" for i in (1, 2))
    apart = "((a.x[1] - b.x[1]) * (b.s1 - a.s1) + (a.x[2] - b.x[2]) * (b.s2 - a.s2))"
    k = f"(-({_SLOPE} + 0.75 * {_R2} * pow(1 + {_R2} / 2, -2.5) + {_SLOPE}) + {_SLOPE} * {apart} + pow(1 + {_R2} / 2, -0.5) * (a.s1 * b.s1 + a.s2 * b.s2))"
    maha = "((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]) * c22 - 2 * (a.x[1] - b.x[1]) * (a.x[2] - b.x[2]) * c12 + (a.x[2] - b.x[2]) * (a.x[2] - b.x[2]) * c11) / det"
    steps = [
        f"d AS MATERIALIZED ({P})",
        "t AS (SELECT sum(w) AS total FROM d)",
        "v AS MATERIALIZED (SELECT i, x, w / total AS v FROM d, t)",
        "u AS (SELECT sum(v * x[1]) AS u1, sum(v * x[2]) AS u2, sum(v * v) AS vv FROM v)",
        "cov AS (SELECT pow(any_value(vv), 1.0 / 3) / (1 - any_value(vv)) AS f, sum(v * (x[1] - u1) * (x[1] - u1)) AS a11, sum(v * (x[1] - u1) * (x[2] - u2)) AS a12, sum(v * (x[2] - u2) * (x[2] - u2)) AS a22 FROM v, u)",
        "inv AS (SELECT f * a11 AS c11, f * a12 AS c12, f * a22 AS c22, f * f * (a11 * a22 - a12 * a12) AS det FROM cov)",
        f"l AS MATERIALIZED (SELECT a.i, ln(sum(b.v * exp(-{maha} / 2))) - 0.5 * ln(any_value(det)) - ln(2 * pi()) AS log FROM v a, v b, inv GROUP BY a.i)",
        f"mo AS MATERIALIZED (SELECT a.i, any_value(a.x) AS x, {moments} FROM d a, d b GROUP BY a.i)",
        "p AS MATERIALIZED (SELECT i, x, m1 - x[1] AS s1, m2 - x[2] AS s2, greatest(q1 - m1 * m1 - 1, 0) + greatest(q2 - m2 * m2 - 1, 0) AS laplace, log FROM mo JOIN l USING (i))",
    ]
    for s in range(m):
        before = " UNION ALL ".join(f"SELECT i FROM c{t}" for t in range(s))
        penalty = f"(SELECT a.i, sum({k}) AS pen FROM p a, p b WHERE b.i IN ({before}) GROUP BY a.i)" if s else "(SELECT i, 0.0 AS pen FROM p)"
        out = f"WHERE p.i NOT IN ({before})" if s else ""
        steps.append(f"c{s} AS MATERIALIZED (SELECT {s} AS pos, p.i FROM p JOIN {penalty} q ON p.i = q.i {out} ORDER BY 1 + s1 * s1 + s2 * s2 + 2 * pen + laplace - {s + 1} * log / {m}, p.i LIMIT 1)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT pos, i AS id FROM c{s}" for s in range(m))


@query("stein_thinning_regularised", _regularised_stein_sql(10))
def stein_thinning_regularised(spark, sf_dir):
    return _picked(solvers.SteinThinning(10, PCIMQ).reduce(parts(spark, sf_dir)))


@query("greedy_kernel_points")
def greedy_kernel_points(spark, sf_dir):
    return _picked(solvers.GreedyKernelPoints(4, SE).reduce(embeddings(spark, sf_dir, y="label")))


# two places of greedy kernel points: ridge systems of one and two equations
def _beside(name: str, kept: str) -> str:
    """The point that is best together with the kept one."""
    return f"""{name} AS MATERIALIZED (WITH f AS (SELECT i, k AS k0, yb AS y0 FROM k WHERE j = (SELECT j FROM {kept})),
g AS (SELECT k.j, ((1 + 1e-6) * f.y0 - h.k0 * k.yb) / (pow(1 + 1e-6, 2) - h.k0 * h.k0) AS a0, ((1 + 1e-6) * k.yb - h.k0 * f.y0) / (pow(1 + 1e-6, 2) - h.k0 * h.k0) AS a1, f.k0, k.k, k.ya FROM k JOIN f ON f.i = k.i JOIN f h ON h.i = k.j WHERE k.j <> (SELECT j FROM {kept}))
SELECT j FROM (SELECT j, sum(pow(a0 * k0 + a1 * k, 2) - 2 * (a0 * k0 + a1 * k) * ya) AS loss FROM g GROUP BY j) ORDER BY loss, j LIMIT 1)"""


_FIRST = f"""WITH p AS MATERIALIZED ({_L}), k AS MATERIALIZED (SELECT a.i, b.i AS j, a.y AS ya, b.y AS yb, {SE.sql(*D)} AS k FROM p a, p b),
one AS (SELECT j, sum(k * k) * pow(any_value(yb) / (1 + 1e-6), 2) - 2 * sum(k * ya) * any_value(yb) / (1 + 1e-6) AS loss FROM k GROUP BY j),
c0 AS MATERIALIZED (SELECT j FROM one ORDER BY loss, j LIMIT 1), """
_PAIR_SQL = _FIRST + _beside("c1", "c0") + " SELECT 0 AS pos, j AS id FROM c0 UNION ALL SELECT 1, j FROM c1"
_REFINED_SQL = _FIRST + ", ".join((_beside("c1", "c0"), _beside("r0", "c1"), _beside("r1", "r0"))) + " SELECT 0 AS pos, j AS id FROM r0 UNION ALL SELECT 1, j FROM r1"


@query("greedy_kernel_points_pair", _PAIR_SQL)
def greedy_kernel_points_pair(spark, sf_dir):
    return _picked(solvers.GreedyKernelPoints(2, SE).reduce(embeddings(spark, sf_dir, y="label")))


@query("greedy_kernel_points_pair_refined", _REFINED_SQL)
def greedy_kernel_points_pair_refined(spark, sf_dir):
    solver, p = solvers.GreedyKernelPoints(2, SE), embeddings(spark, sf_dir, y="label")
    return _picked(solver.refine(solver.reduce(p)))


@query("greedy_kernel_points_refine")
def greedy_kernel_points_refine(spark, sf_dir):
    solver, p = solvers.GreedyKernelPoints(4, SE), embeddings(spark, sf_dir, y="label")
    return _picked(solver.refine(solver.reduce(p)))


@query("kernel_thinning")
def kernel_thinning(spark, sf_dir):
    return _picked(solvers.KernelThinning(16, SE).reduce(embeddings(spark, sf_dir)))


# a recursive query: sigma, and per point the sums over seen pairs and over the first half
_HALF = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) AS r, i, x FROM ({E})),
k AS MATERIALIZED (SELECT a.r, any_value(a.i) AS i, list({SE.sql(*D)} ORDER BY b.r) AS k FROM p a, p b GROUP BY a.r),
h(t, sigma, seen, chosen, i) AS (SELECT CAST(0 AS BIGINT), 0.0::DOUBLE, (SELECT list(0.0::DOUBLE) FROM p), (SELECT list(0.0::DOUBLE) FROM p), CAST(NULL AS BIGINT) UNION ALL
 SELECT t + 1, CASE WHEN width > 0 THEN sqrt(sigma * sigma + greatest(gap * (1 + (gap - 2 * width) * sigma * sigma / (width * width)), 0)) ELSE sigma END, seen2,
 list_transform(chosen, lambda v, z: v + CASE WHEN swap THEN kb[z] ELSE ka[z] END), CASE WHEN swap THEN ib ELSE ia END FROM
 (SELECT *, width > 0 AND 0.5 <= (1 - alpha / width) / 2 AS swap, list_transform(seen, lambda v, z: v + ka[z] + kb[z]) AS seen2 FROM
 (SELECT *, greatest(sqrt(gap) * sigma * sqrt(2 * ln(2 / 0.1)), gap) AS width, seen[2 * t + 1] - seen[2 * t + 2] - 2 * (chosen[2 * t + 1] - chosen[2 * t + 2]) AS alpha FROM
 (SELECT h.*, a.k AS ka, b.k AS kb, a.i AS ia, b.i AS ib, greatest(2 - 2 * a.k[2 * h.t + 2], 0) AS gap FROM h JOIN k a ON a.r = 2 * h.t + 1 JOIN k b ON b.r = 2 * h.t + 2))))
SELECT CAST(t - 1 AS INT) AS pos, i AS id FROM h WHERE t > 0"""


@query("kernel_halving", _HALF)
def kernel_halving(spark, sf_dir):
    data = embeddings(spark, sf_dir).local()
    first, _ = kt_half(data.x, SE, 0.1, np.full(len(data), 0.5), lambda *sides: solvers.later_sums(spark, SE, *sides))
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(data.idx[first])], "pos int, id long")


@query("compress_plus_plus")
def compress_plus_plus(spark, sf_dir):
    return _picked(solvers.CompressPlusPlus(2, 16, SE).reduce(embeddings(spark, sf_dir)))


@query("map_reduce_herding")
def map_reduce_herding(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem")
    p = points(df.withColumn("key", F.xxhash64(*df.columns)), "key", [F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10])
    return _picked(solvers.MapReduce(solvers.KernelHerding(25, K.SquaredExponential(0.5)), 2000).reduce(p.spread(4 * spark.sparkContext.defaultParallelism)))


_R1 = "((a.x[1] - b.x[1]) * (a.x[1] - b.x[1]))"
_S1 = f"(-0.5 * pow(1 + {_R1} / 2, -1.5))"
_STEIN1 = f"(-({_S1} + 0.75 * {_R1} * pow(1 + {_R1} / 2, -2.5)) + {_S1} * {_R1} + pow(1 + {_R1} / 2, -0.5) * a.x[1] * b.x[1])"


@query("ksd_regularised", f"""WITH p AS MATERIALIZED ({S}), c AS (SELECT pow(count(*), -0.4) * var_samp(x[1]) AS cov, count(*) AS n FROM p),
k AS (SELECT sum({_STEIN1}) / any_value(n * n) AS mean FROM p a, p b, c),
m AS (SELECT a.i, sum(b.x[1] * exp(-{_R1} / 2)) / sum(exp(-{_R1} / 2)) AS m, sum(b.x[1] * b.x[1] * exp(-{_R1} / 2)) / sum(exp(-{_R1} / 2)) AS q, ln(avg(exp(-{_R1} / (2 * cov)))) - 0.5 * ln(any_value(cov)) - 0.5 * ln(2 * pi()) AS log FROM p a, p b, c GROUP BY a.i)
SELECT round(sqrt(greatest(0, any_value(mean) + sum(greatest(q - m * m - 1, 0)) / any_value(n * n) - avg(log) / any_value(n))), 6) AS value FROM m, k, c""")
def ksd_regularised(spark, sf_dir):
    """With the Laplace and the entropic term."""
    p = suppliers(spark, sf_dir)
    curvature = score.KdeScore(p.local().x, 1.0)
    return _one(spark, value=metrics.ksd(p, p, K.Stein(PCIMQ, gaussian_score), lambda x: curvature.with_curvature(x)[1], entropic=True))


@query("amcmd")
def amcmd(spark, sf_dir):
    a, b = (embeddings(spark, sf_dir, f"vec_id % 2 = {i}", y="label") for i in (0, 1))
    return _one(spark, value=metrics.amcmd(a, b, SE, SE, 1e-3))


# a linear feature kernel of one coordinate: its systems are the identity and one direction, so their inverses are written down
@query("amcmd_linear", f"""WITH p AS (SELECT s_suppkey % 2 AS h, s_acctbal / 5000.0::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier), s AS (SELECT h, sum(x * x) AS s, count(*) AS n FROM p GROUP BY h),
v AS (SELECT h, x / (1e-3 + s) AS v, y FROM p JOIN s USING (h)), t AS (SELECT sum(CASE WHEN a.h = b.h THEN 1 ELSE -1 END * a.v * b.v * {SE.sql('abs(a.y - b.y)', '0', '0')}) AS t FROM v a, v b)
SELECT round(sqrt(greatest(0, s / n * t)), 6) AS value FROM s, t WHERE h = 0""")
def amcmd_linear(spark, sf_dir):
    a, b = (suppliers(spark, sf_dir, f"s_suppkey % 2 = {i}", y="s_nationkey") for i in (0, 1))
    return _one(spark, value=metrics.amcmd(a, b, K.Linear(1.0, 0.0), SE, 1e-3))


def _two_marks(targets: str, train: str, marks: str) -> str:
    """The regression on kernels to two landmarks c0 and c1, by its normal equations."""
    return f"""WITH p AS MATERIALIZED ({E}), {marks}, f AS MATERIALIZED (SELECT a.i, max(CASE WHEN b.i = (SELECT i FROM c0) THEN {SE.sql(*D)} END) AS f0, max(CASE WHEN b.i = (SELECT i FROM c1) THEN {SE.sql(*D)} END) AS f1
FROM p a JOIN p b ON b.i IN (SELECT i FROM c0 UNION ALL SELECT i FROM c1) GROUP BY a.i), train AS MATERIALIZED ({train}), t AS ({targets}),
n AS (SELECT sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11, sum(f0 * t) AS b0, sum(f1 * t) AS b1 FROM f JOIN t USING (i))
SELECT i AS id, round((f0 * (g11 * b0 - g01 * b1) + f1 * (g00 * b1 - g01 * b0)) / (g00 * g11 - g01 * g01), 6) AS mean FROM f, n"""


def _hashed(seed: int, size: int, skip: int = 0) -> str:
    return f"SELECT i FROM p ORDER BY {_uniform_sql(seed)}, i LIMIT {size} OFFSET {skip}"


_FULL = f"SELECT a.i, sum(b.w * {SE.sql(*D)}) / sum(b.w) AS t FROM p a JOIN train USING (i), p b GROUP BY a.i"
_OWN = f"SELECT a.i, avg({SE.sql(*D)}) AS t FROM p a JOIN train USING (i), p b WHERE b.i IN (SELECT i FROM train) GROUP BY a.i"
_DRAWN = f"c0 AS MATERIALIZED ({_hashed(0, 1)}), c1 AS MATERIALIZED ({_hashed(0, 1, 1)})"
_APART = f"c0 AS MATERIALIZED (SELECT min(i) AS i FROM p), c1 AS MATERIALIZED (SELECT b.i FROM p a, p b WHERE a.i = (SELECT i FROM c0) AND b.i <> a.i ORDER BY {SE.sql(*D)}, b.i LIMIT 1)"


def _approximate(kind, marks: int = 100):
    def run(spark, sf_dir):
        return kind(SE, marks, 200).gramian_row_mean(embeddings(spark, sf_dir)).select(F.col("_idx").alias("id"), F.round("mean", 6).alias("mean"))

    return run


for _kind in (approx.MonteCarlo, approx.ANNchor, approx.Nystrom):
    query(f"approximate_{_kind.__name__.lower()}")(_approximate(_kind))
query("approximate_montecarlo_pair", _two_marks(_FULL, _hashed(1, 200), _DRAWN))(_approximate(approx.MonteCarlo, 2))
query("approximate_annchor_pair", _two_marks(_FULL, _hashed(1, 200), _APART))(_approximate(approx.ANNchor, 2))
query("approximate_nystrom_pair", _two_marks(_OWN, _hashed(0, 2), _DRAWN))(_approximate(approx.Nystrom, 2))


@query("sliced_score")
def sliced_score(spark, sf_dir):
    p = parts(spark, sf_dir)
    net = score.ScoreNetwork((32, 32), epochs=3).fit_points(p)
    return score.score_table(p, net).select(F.col("_idx").alias("id"), F.round(F.col("score")[0], 6).alias("s0"), F.round(F.col("score")[1], 6).alias("s1"))


@query("randomised_eigen")
def randomised_eigen(spark, sf_dir):
    x = suppliers(spark, sf_dir).local().x
    values, _ = RandomisedEigen(oversampling=10).eigen(pairwise.gram(spark, x, SE))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(sorted(values, reverse=True)[:5])], "pos int, value double")


# x x' + 1 has two eigenvalues, those of the 2 x 2 moments; its smallest solution lies in the span of x and 1
_MOMENTS = "WITH p AS (SELECT s_suppkey AS i, s_acctbal / 5000.0::DOUBLE AS x, s_nationkey::DOUBLE AS y FROM supplier), m AS (SELECT sum(x * x) AS a, sum(x) AS b, count(*)::DOUBLE AS c, sum(x * y) AS u, sum(y) AS v FROM p)"


@query("randomised_eigen_linear", _MOMENTS + " SELECT 0 AS pos, round((a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2, 6) AS value FROM m UNION ALL SELECT 1, round((a + c - sqrt(pow(a - c, 2) + 4 * b * b)) / 2, 6) FROM m")
def randomised_eigen_linear(spark, sf_dir):
    x = suppliers(spark, sf_dir).local().x
    values, _ = RandomisedEigen(oversampling=10).eigen(pairwise.gram(spark, x, K.Linear(1.0, 1.0)))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(sorted(values, reverse=True)[:2])], "pos int, value double")


_INVERSE_TWICE = "(c * p0 - b * p1) / det AS q0, (a * p1 - b * p0) / det AS q1"


@query("least_squares", _MOMENTS + f""", d AS (SELECT *, a * c - b * b AS det, (c * u - b * v) / (a * c - b * b) AS p0, (a * v - b * u) / (a * c - b * b) AS p1 FROM m), q AS (SELECT c, {_INVERSE_TWICE} FROM d)
SELECT i AS id, round(c * (q0 * x + q1), 6) AS minimal, round(c * (q0 * x + q1), 6) AS randomised FROM p, q""")
def least_squares(spark, sf_dir):
    """The smallest solution of a system of rank two, by both solvers, times the number of rows."""
    data = suppliers(spark, sf_dir, y="s_nationkey").local()
    gram = pairwise.gram(spark, data.x, K.Linear(1.0, 1.0))
    found = [len(data) * s.solve(gram, 0.0, data.y)[:, 0] for s in (MinimalNorm(1e-9), RandomisedEigen(oversampling=10, rcond=1e-9))]
    return spark.createDataFrame([(int(i), round(float(a), 6), round(float(b), 6)) for i, a, b in zip(data.idx, *found, strict=True)], "id long, minimal double, randomised double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Herding on the embeddings."""
    return herding(spark, sf_dir)


