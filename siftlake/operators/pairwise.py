"""Kernel means over pairs of points, as a join with column arithmetic or as blocks of numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.kernels import Kernel, paired, sq_dist
from siftlake.functions.linalg import Factored, Gram
from siftlake.functions.series import Interpolant
from siftlake.sources.points import Local, Points, coordinates, matrix, stacked

#: Bytes of one side that is broadcast at once; a larger side is taken in blocks.
BLOCK_BYTES = 32 << 20
#: Rows of the broadcast side and pairs that a task evaluates at once.
TILE_ROWS, TILE_PAIRS = 512, 1 << 15
#: Bytes of sums that all tasks may return of pairs evaluated once.
SYMMETRIC_BYTES = 32 << 20
#: Bytes of a table of kernels that one process makes.
GRAM_BYTES = 64 << 20
#: Pairs up to which equal points are not looked for.
MERGED_PAIRS = 1 << 24
#: Coordinates up to which smooth kernel sums are interpolated, and points for each node from which on that pays.
SERIES_DIMENSIONS, SERIES_GAIN = 3, 16
#: Rows at which a series is evaluated at once.
SERIES_ROWS = 1 << 13
#: Rows from which on those of fewer partitions than cores are dealt out for such a pass.
SERIES_DEALT = 1 << 17
#: Pairs of nodes of both sides that this process evaluates.
NODE_PAIRS = 1 << 24


def distances(d: int, a: str = "a.x", b: str = "b.x") -> tuple[str, str, str]:
    """SQL for distance, L1 distance and inner product with the coordinates written out (Spark arrays)."""
    pairs = [(f"{a}[{i}]", f"{b}[{i}]") for i in range(d)]
    return "sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in pairs) + ")", "(" + " + ".join(f"abs({p} - {q})" for p, q in pairs) + ")", "(" + " + ".join(f"{p} * {q}" for p, q in pairs) + ")"


def row_mean_sql(x: Points, landmarks: Points, kernel: Kernel, d: int, limit: int = 100_000) -> DataFrame:
    """(_idx, mean) by a broadcast join and column expressions; for few landmarks, whose number is checked."""
    n = landmarks.count()
    if n > limit:
        raise ValueError(f"{n} landmarks are too many for a broadcast join; use row_mean")
    return (
        x.df.alias("a").crossJoin(F.broadcast(landmarks.df.alias("b")))
        .select(F.col("a._idx").alias("_idx"), F.col("b.w").alias("w"), F.expr(kernel.sql(*distances(d))).alias("k"))
        .groupBy("_idx").agg((F.sum(F.col("w") * F.col("k")) / F.sum("w")).alias("mean"))
    )


def blocks(y: Points, block_bytes: int = BLOCK_BYTES):
    """The points in this process block by block, each of about block_bytes at most; a block is drawn by a hash of _idx."""
    n, d = y.df.agg(F.count("*"), F.max(F.size("x") + (F.size("y") if y.supervised else F.lit(0)))).first()
    count = max(1, math.ceil(n * ((d or 0) + 2) * 8 / block_bytes))
    for b in range(count):
        part = y.df if count == 1 else y.df.where(F.pmod(F.xxhash64("_idx"), F.lit(count)) == b)
        yield count, Local.of(part.toArrow())


def tiled(function, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """function(a, b, w) tile by tile: its results are one row for each of a, sums over b."""
    step = max(1, TILE_PAIRS // max(1, min(len(b), TILE_ROWS)))
    rows = []
    for lo in range(0, max(1, len(a)), step):
        total = None
        for k in range(0, max(1, len(b)), TILE_ROWS):
            got = function(a[lo : lo + step], b[k : k + TILE_ROWS], w[k : k + TILE_ROWS])
            total = got if total is None else tuple(p + q for p, q in zip(total, got, strict=True))
        rows.append(total)
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def weighted_sums(x: Points, y: Points, function, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_idx, w, *schema): function(x rows, y rows, y weights) returns a column array for each name, sums over y; tiles and blocks of y are added up.

    y is broadcast in blocks of a bounded size, and each block meets all of x in one pass without a shuffle.
    """
    spark, names = x.df.sparkSession, [c.split()[0] for c in schema.split(",")]
    key = dict(x.df.dtypes)["_idx"]
    out = None
    for count, block in blocks(y, block_bytes):
        shared = spark.sparkContext.broadcast((block.x, block.w))

        def run(batches, shared=shared):
            for batch in batches:
                if batch.num_rows:
                    got = tiled(function, matrix(batch.column(1)), *shared.value)
                    columns = [pa.array(list(c)) if c.ndim > 1 else pa.array(c) for c in got]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["_idx", "w", *names])

        part = x.df.select("_idx", "x", "w").mapInArrow(run, f"_idx {key}, w double, {schema}")
        out = part if out is None else out.unionByName(part)
    if count > 1:
        arrays = [c.split()[0] for c in schema.split(",") if "array" in c]
        if arrays:
            raise ValueError("vector sums take one block only; raise block_bytes")
        out = out.groupBy("_idx", "w").agg(*[F.sum(c).alias(c) for c in names])
    return out


def evaluated(p: Points, function, width: int) -> np.ndarray:
    """function(rows) -> array of `width` columns, on all executors in small runs of rows; the values in this process, by ascending _idx."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                got = np.concatenate([np.asarray(function(x[i : i + 256]), float).reshape(-1, width) for i in range(0, len(x), 256)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in got], pa.binary())], ["_idx", "v"])

    rows = p.df.select("_idx", "x").mapInArrow(run, f"_idx {dict(p.df.dtypes)['_idx']}, v binary").orderBy("_idx").toArrow()
    return np.frombuffer(b"".join(rows["v"].to_pylist()), float).reshape(-1, width)


def products(spark, x: np.ndarray, y: np.ndarray, kernel: Kernel, q: np.ndarray) -> np.ndarray:
    """k(x, y) @ q, runs of rows of x on all executors; both sides and q are broadcast once, so they come from local().

    Of one side with itself and few columns each pair is evaluated once."""
    if x is y and 2 * spark.sparkContext.defaultParallelism * q.nbytes <= SYMMETRIC_BYTES:
        got = symmetric_products(spark, x, kernel, q.reshape(len(x), -1))[0]
        return got.reshape(q.shape)
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, len(x) // 64))
    cuts = np.linspace(0, len(x), tasks + 1).astype(int).tolist()
    shared = spark.sparkContext.broadcast((x, y, q))

    def run(batches):
        a, b, c = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                (got,) = tiled(lambda s, t, w: (kernel(s, t) @ w,), a[cuts[i] : cuts[i + 1]], b, c)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.ascontiguousarray(got).tobytes()], pa.binary())], ["i", "v"])

    rows = spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, v binary").collect()
    shared.destroy()
    return np.frombuffer(b"".join(r.v for r in sorted(rows, key=lambda r: r.i)), float).reshape(len(x), *q.shape[1:])


def symmetric_products(spark, x: np.ndarray, kernel: Kernel, v: np.ndarray, squares: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """k(x, x) @ v and, if asked for, the row sums of k(x, x)**2: each pair is evaluated once, strips of rows on all executors."""
    tasks, rows = 2 * spark.sparkContext.defaultParallelism, 128
    shared = spark.sparkContext.broadcast((x, v))

    def run(batches):
        x, v = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                out = np.zeros((len(x), v.shape[1] + squares))
                for lo in range(rows * i, len(x), rows * tasks):
                    hi = min(len(x), lo + rows)
                    for first, last in ((lo, hi), *((k, min(len(x), k + TILE_ROWS)) for k in range(hi, len(x), TILE_ROWS))):
                        k = kernel(x[lo:hi], x[first:last])
                        sides = [(lo, hi, k, v[first:last])] + [(first, last, k.T, v[lo:hi])] * (first > lo)
                        for a, b, table, by in sides:
                            out[a:b, : v.shape[1]] += table @ by
                        if squares:
                            k = k * k
                            out[lo:hi, -1] += k.sum(1)
                            if first > lo:
                                out[first:last, -1] += k.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out.tobytes()], pa.binary())], ["i", "v"])

    total = np.zeros((len(x), v.shape[1] + squares))
    for r in sorted(spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, v binary").collect(), key=lambda r: r.i):
        total += np.frombuffer(r.v).reshape(total.shape)
    shared.destroy()
    return total[:, : v.shape[1]], total[:, -1] if squares else None


class KernelGram(Gram):
    """k(x, x), multiplied on the executors."""

    def __init__(self, spark, x: np.ndarray, kernel: Kernel):
        super().__init__(len(x))
        self.spark, self.x, self.kernel = spark, x, kernel

    def product(self, q):
        return products(self.spark, self.x, self.x, self.kernel, q)


def gram(spark, x: np.ndarray, kernel: Kernel, limit: int = GRAM_BYTES) -> np.ndarray | Gram:
    """k(x, x): a table up to `limit` bytes, beyond them something that multiplies like it."""
    if len(x) ** 2 * 8 <= limit:
        table = np.empty((len(x), len(x)))
        for lo in range(0, len(x), 256):
            table[lo : lo + 256] = kernel(x[lo : lo + 256], x)
        return table
    f = kernel.features(x)
    return KernelGram(spark, x, kernel) if f is None else Factored(f)


def elementwise(df: DataFrame, key: str, x: str, y: str, kernel: Kernel) -> DataFrame:
    """(key, k, grad_x, grad_y, divergence) of the vectors x and y of each row, without a shuffle; rows without one of them are left out."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = matrix(batch.column(1)), matrix(batch.column(2))
                gx, gy = (pa.array(list(paired(g, a, b)), pa.list_(pa.float64())) for g in (kernel.grad_x, kernel.grad_y))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernel.elementwise(a, b)), gx, gy, pa.array(paired(kernel.divergence, a, b))], [key, "k", "grad_x", "grad_y", "divergence"])

    given = df.where(df[x].isNotNull() & df[y].isNotNull()).select(key, df[x].cast("array<double>"), df[y].cast("array<double>"))
    return given.mapInArrow(run, f"`{key}` {kind}, k double, grad_x array<double>, grad_y array<double>, divergence double")


def merged(p: Points) -> Points:
    """Equal vectors as one point, with the lowest _idx and the sum of the weights."""
    some = p.df.groupBy("x").agg(F.min("_idx").alias("_idx"), F.sum("w").alias("w")).select("_idx", "x", "w")
    return Points(some).spread(4 * p.df.sparkSession.sparkContext.defaultParallelism)


def _repeats(*sides: Points) -> list[bool]:
    """Of each side whether half of its points or more have the vector of another; where pairs are few, no side is looked at."""
    n = [p.count() for p in sides]
    if n[0] * n[-1] <= MERGED_PAIRS:
        return [False] * len(sides)
    return [2 * p.df.select("x").distinct().count() <= k for p, k in zip(sides, n, strict=True)]


def total_sums(rows: DataFrame, function, shape: tuple[int, ...], step: int = TILE_ROWS) -> np.ndarray:
    """The sum of function(vectors, weights) -> array of `shape`, over small runs of all rows (w, and x or its coordinates) on all executors; nothing else leaves them."""
    arrays = rows.columns[1] == "x"

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                w, at = batch.column(0).to_numpy(zero_copy_only=False).astype(float), matrix(batch.column(1)) if arrays else stacked(batch.columns[1:])
                for lo in range(0, len(at), step):
                    total += function(at[lo : lo + step], w[lo : lo + step])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = rows.mapInArrow(run, "v binary").collect()
    return sum((np.frombuffer(r.v).reshape(shape) for r in sums), np.zeros(shape))


def _bounds(p: Points) -> tuple[int, float, int, np.ndarray | None]:
    """Number, sum of weights, partitions and box (rows of least and largest) of all points; no box where they have many coordinates, or other numbers of these, or such that are not finite."""
    sides = [f(F.get("x", F.lit(i)).cast("double")) for i in range(SERIES_DIMENSIONS) for f in (F.min, F.max)]
    rows = p.rows.select("x", "w", F.spark_partition_id().alias("part"))
    n, total, last, given, least, d, *box = rows.agg(F.count("*"), F.sum("w"), F.max("part"), F.count("x"), F.min(F.size("x")), F.max(F.size("x")), *sides).first()
    if not n or n != given or least != d or not 1 <= d <= SERIES_DIMENSIONS or None in box[: 2 * d] or not np.isfinite(box[: 2 * d]).all():
        return n, total, 0, None
    return n, total, last + 1, np.reshape(box[: 2 * d], (d, 2))


def _plain(p: Points, d: int, n: int, partitions: int) -> DataFrame:
    """_idx, w and the coordinates of n points, each a column; dealt out where their own partitions are few."""
    rows, cores = p.rows.select("_idx", "w", *coordinates(d)), p.df.sparkSession.sparkContext.defaultParallelism
    return rows if n < SERIES_DEALT or partitions >= cores else rows.repartition(cores, "_idx")


def _node_sums(grid: Interpolant, other: Interpolant, moments: np.ndarray, kernel: Kernel) -> np.ndarray | None:
    """Terms at the nodes of a grid of sums over all points that the other grid's moments (of the kernel's charges) are of; None where the kernel has no short series there."""
    at, far = grid.nodes(), other.nodes()
    step = max(1, TILE_PAIRS // len(far))
    out = []
    for a in (at[i : i + step] for i in range(0, len(at), step)):
        made = [other.fitted(table.T) for table in kernel.tables(a, far)]
        if any(m is None for m in made):
            return None
        out.append(kernel.of_tables(a, np.array([m.against(moments) for m in made])))
    return np.concatenate(out)


def _pays(grid: Interpolant, other: Interpolant, number: int) -> bool:
    """Whether a side of so many points is met by its moments, not point by point."""
    return number >= SERIES_GAIN * other.count and grid.count * other.count <= NODE_PAIRS


def _interpolant(x: Points, y: Points, kernel: Kernel) -> tuple[DataFrame, Interpolant, float] | None:
    """The rows of x, kernel sums over all of y as a function of x, and the sum of y's weights; for a smooth kernel and points of few coordinates that are many more than its nodes."""
    reach = kernel.smooth()
    if reach is None:
        return None
    n, total, parts, box = _bounds(x)
    if box is None:
        return None
    grid, rows = Interpolant.over(box, reach), _plain(x, len(box), n, parts)
    if n < SERIES_GAIN * grid.count:
        return None
    number, total, parts, far = (n, total, parts, box) if x is y else _bounds(y)
    if n * number <= MERGED_PAIRS or not total:
        return None
    other = None if far is None or len(far) != len(box) else Interpolant.over(far, reach)
    if other is not None and _pays(grid, other, number):
        shape = other.moments(far[:, 0][None], kernel.charges(far[:, 0][None], np.ones(1))).shape
        met = (rows if x is y else _plain(y, len(far), number, parts)).drop("_idx")
        values = _node_sums(grid, other, total_sums(met, lambda at, w: other.moments(at, kernel.charges(at, w)), shape, 1 << 14), kernel)
        found = None if values is None else grid.fitted(values)
        if found is not None:
            return rows, found, total
    at = grid.nodes()
    width = kernel.terms(at[:1], at[:1], np.ones(1)).shape[1]
    step = max(1, TILE_PAIRS // TILE_ROWS)

    def run(some, w):
        return np.concatenate([kernel.terms(at[i : i + step], some, w) for i in range(0, len(at), step)])

    found = grid.fitted(total_sums(y.df.select("w", "x"), run, (len(at), width)))
    return None if found is None else (rows, found, total)


def _at(found: Interpolant, kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """Interpolated kernel sums at rows."""
    return np.concatenate([np.zeros(0), *(kernel.of_terms(a, found(a)) for a in (x[i : i + SERIES_ROWS] for i in range(0, len(x), SERIES_ROWS)))])


def smooth_means(x: np.ndarray, w: np.ndarray, kernel: Kernel) -> np.ndarray | None:
    """As row_mean() of points with themselves that are in this process already, in time of their number; None where it takes all pairs."""
    reach = kernel.smooth()
    if reach is None or not len(x) or not 1 <= x.shape[1] <= SERIES_DIMENSIONS or not np.isfinite(x).all() or not w.sum():
        return None
    grid = Interpolant.over(np.column_stack((x.min(0), x.max(0))), reach)
    if not _pays(grid, grid, len(x)):
        return None
    step = 1 << 14
    moments = sum(grid.moments(x[i : i + step], kernel.charges(x[i : i + step], w[i : i + step])) for i in range(0, len(x), step))
    values = _node_sums(grid, grid, moments, kernel)
    found = None if values is None else grid.fitted(values)
    return None if found is None else _at(found, kernel, x) / w.sum()


def _interpolated(x: Points, y: Points, kernel: Kernel) -> DataFrame | None:
    """As row_mean(), by the sums over all of y at the nodes of an interpolation in x; None where it does not pay or its series do not fall off."""
    made = _interpolant(x, y, kernel)
    if made is None:
        return None
    rows, found, total = made

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = _at(found, kernel, stacked(batch.columns[2:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got / total)], ["_idx", "w", "mean"])

    return rows.mapInArrow(run, f"_idx {dict(x.df.dtypes)['_idx']}, w double, mean double")


def row_mean(x: Points, y: Points, kernel: Kernel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_idx, w, mean): of each x the weighted mean of k(x, y) over y (axis 1). Equal vectors are evaluated once where they are many,
    and of smooth kernels of few coordinates only nodes meet all of y."""
    smooth = _interpolated(x, y, kernel)
    if smooth is not None:
        return smooth
    repeats = _repeats(x) * 2 if x is y else _repeats(x, y)
    return _row_mean(x, y, kernel, block_bytes, *repeats)


def _row_mean(x, y, kernel, block_bytes, x_repeats, y_repeats):
    total = y.df.agg(F.sum("w")).first()[0]
    sums = weighted_sums(merged(x) if x_repeats else x, merged(y) if y_repeats else y, lambda a, b, w: (kernel(a, b) @ w,), "mean double", block_bytes)
    means = sums.withColumn("mean", F.col("mean") / F.lit(total))
    if not x_repeats:
        return means
    least = x.df.groupBy("x").agg(F.min("_idx").alias("_idx")).join(means.select("_idx", "mean"), "_idx").drop("_idx")
    return x.df.join(least, "x").select("_idx", "w", "mean")


def column_mean(x: Points, y: Points, kernel: Kernel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same over x, for each y (axis 0): kernels are symmetric."""
    return row_mean(y, x, kernel, block_bytes)


def mean(x: Points, y: Points, kernel: Kernel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (mean): the weighted mean over all pairs."""
    rows = _interpolated(x, y, kernel)
    if rows is not None:
        return rows.agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("mean"))
    x_repeats, y_repeats = _repeats(x) * 2 if x is y else _repeats(x, y)
    rows = _row_mean(merged(x) if x_repeats else x, y, kernel, block_bytes, False, y_repeats)
    return rows.agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("mean"))


def gramian_row_mean(x: Points, kernel: Kernel, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return row_mean(x, x, kernel, block_bytes)


def median_heuristic(x: Points, d: int, limit: int = 5_000) -> DataFrame:
    """One row (length_scale): sqrt(median squared distance / 2) over pairs of different rows; of more than `limit` points by counting."""
    if x.count() > limit:
        spark = x.df.sparkSession
        return spark.createDataFrame([(math.sqrt(median_distance(x) / 2),)], "length_scale double")
    r, _, _ = distances(d)
    pairs = x.df.alias("a").join(F.broadcast(x.df.alias("b")), F.expr("a._idx < b._idx"))
    return pairs.select(F.expr(f"pow({r}, 2)").alias("s")).agg(F.sqrt(F.median("s") / 2).alias("length_scale"))


def median_distance(x: Points, bins: int = 1 << 14, collected: int = 1 << 20) -> float:
    """The median squared distance of all pairs of different rows, exactly: each pass over the pairs counts them in bins between
    the last bounds, until those that may be the median are few. Equal vectors are one with a number."""
    spark = x.df.sparkSession
    rows = merged(Points(x.df.withColumn("w", F.lit(1.0)))).local()
    at, number = rows.x, rows.w
    pairs = int(number.sum()) * (int(number.sum()) - 1) // 2
    wanted = ((pairs - 1) // 2, pairs // 2)
    tasks = 4 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast((at, number))

    def run_over(bounds, scale):
        """(count of each bin, or values and counts with scale None) of the pairs within the bounds, a row for each task."""
        def within(values, count):
            for low, by, first, last in bounds:
                some = np.floor((values - low) * by)
                some = (some >= first) & (some <= last)
                values, count = values[some], count[some]
            return values, count

        def run(batches):
            x, w = shared.value
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    total, kept = np.zeros(bins), [(np.zeros(0), np.zeros(0))]
                    for lo in range(64 * i, len(x), 64 * tasks):
                        a, v = x[lo : lo + 64], w[lo : lo + 64]
                        for k in range(lo, len(x), TILE_ROWS):
                            count = v[:, None] * w[None, k : k + TILE_ROWS]
                            if k == lo:
                                count = np.triu(count, 1)
                                own = np.arange(min(len(a), count.shape[1]))
                                count[own, own] = v[own] * (v[own] - 1) / 2
                            values, count = within(sq_dist(a, x[k : k + TILE_ROWS]).ravel(), count.ravel())
                            if scale is None:
                                kept.append((values[count > 0], count[count > 0]))
                            else:
                                total += np.bincount(np.clip((values - scale[0]) * scale[1], 0, bins - 1).astype(np.int64), count, bins)
                    if scale is None:
                        values, back = np.unique(np.concatenate([c[0] for c in kept]), return_inverse=True)
                        total = np.concatenate((values, np.bincount(back, np.concatenate([c[1] for c in kept]), len(values))))
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        return [np.frombuffer(r.v) for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, "v binary").collect()]

    low, high = 0.0, 4 * float(((at - at.mean(0)) ** 2).sum(1).max())
    bounds, before = [], 0
    while pairs > collected and high > low and np.isfinite(bins / (high - low)):
        by = bins / (high - low)
        upto = before + np.cumsum(sum(run_over(bounds, (low, by))))
        first, last = (int(np.searchsorted(upto, k, "right")) for k in wanted)
        bounds.append((low, by, first if first else -np.inf, last if last < bins - 1 else np.inf))
        before = int(upto[first - 1]) if first else before
        left = int(upto[last]) - before
        if left == pairs:
            break
        low, high, pairs = low + first / by, low + (last + 1) / by, left
    found = run_over(bounds, None)
    shared.destroy()
    values = np.concatenate([f[: len(f) // 2] for f in found])
    order = np.argsort(values, kind="stable")
    upto = before + np.cumsum(np.concatenate([f[len(f) // 2 :] for f in found])[order])
    return float(np.mean([values[order][np.searchsorted(upto, k, "right")] for k in wanted]))
