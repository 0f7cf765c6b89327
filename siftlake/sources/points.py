"""Weighted points as DataFrames: (_idx, x, w) and, with responses, y."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one process may hold at once: the driver for a dense solve, a task for a broadcast block.
LOCAL_BYTES = 256 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column as rows of numbers; null coordinates are NaN, null vectors are refused."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError(f"{column.null_count} of {len(column)} vectors are null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def coordinates(d: int) -> list[Column]:
    """The vectors of d numbers as columns of their own, which reach Arrow sooner than arrays."""
    return [F.get("x", F.lit(i)).cast("double").alias(f"x{i}") for i in range(d)]


def stacked(columns: list[pa.Array | pa.ChunkedArray]) -> np.ndarray:
    """Rows of numbers from such columns; null coordinates are NaN."""
    return np.column_stack([pa.chunked_array(c if isinstance(c, pa.ChunkedArray) else [c]).to_numpy().astype(float) for c in columns])


def different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different rows the first positions, ascending, and of all rows the place among them; all rows where fewer than half repeat."""
    _, first, back = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)
    if 2 * len(first) > len(x):
        return np.arange(len(x)), np.arange(len(x))
    order = np.argsort(first)
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    return first[order], place[back.ravel()]


@dataclass(frozen=True)
class Points:
    """A DataFrame of points; _idx is a key of the data, so it is the same at every run. undealt: the same rows before they were spread."""

    df: DataFrame
    undealt: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """For passes with little work for each row, which a shuffle would only delay."""
        return self.df if self.undealt is None else self.undealt

    @property
    def supervised(self) -> bool:
        return "y" in self.df.columns

    def count(self) -> int:
        return self.df.count()

    def positive(self) -> Points:
        """Rows of zero weight never count."""
        return Points(self.df.where("w > 0"))

    def normalised(self, preserve_zeros: bool = False) -> Points:
        """Weights with sum 1; if all are zero, null, or 0 with preserve_zeros."""
        total = self.df.agg(F.sum("w").alias("total"))
        w = F.try_divide("w", "total")
        return Points(self.df.crossJoin(F.broadcast(total)).withColumn("w", F.coalesce(w, F.lit(0.0)) if preserve_zeros else w).drop("total"))

    def joined(self) -> Points:
        """x and y in one vector."""
        return Points(self.df.withColumn("x", F.concat("x", "y")).drop("y"))

    def spread(self, partitions: int) -> Points:
        return Points(self.df.repartition(partitions, "_idx"), self.rows)

    def local(self, limit: int = LOCAL_BYTES) -> Local:
        """All rows in this process, by ascending _idx; refused over `limit` bytes."""
        n, given, least, d = self.rows.agg(F.count("*"), F.count("x"), F.min(F.size("x")), F.max(F.size("x"))).first()
        if n * (d or 0) * 8 > limit:
            raise ValueError(f"{n} points of {d} coordinates are too many for one process; partition them first (map_reduce)")
        if dict(self.df.dtypes)["_idx"] not in ("smallint", "int", "bigint"):
            return Local.of(self.df.orderBy("_idx").toArrow())
        import pyarrow.compute as pc  # here, as workers need not load it

        short = n == given and least == d and 1 <= d <= 8
        table = self.rows.select("_idx", *(coordinates(d) if short else ["x"]), "w", *(["y"] if self.supervised else [])).toArrow()
        table = table.take(pc.sort_indices(table["_idx"], null_placement="at_start"))
        return Local.of(table, stacked(table.columns[1 : 1 + d]) if short else None)


@dataclass
class Local:
    """Points as numpy arrays."""

    idx: np.ndarray
    x: np.ndarray
    w: np.ndarray
    y: np.ndarray | None = None

    @classmethod
    def of(cls, table, x: np.ndarray | None = None) -> Local:
        idx = table["_idx"]
        numbers = pa.types.is_integer(idx.type) and not idx.null_count
        return cls(idx.to_numpy() if numbers else np.array(idx.to_pylist()), matrix(table["x"]) if x is None else x, stacked([table["w"]])[:, 0], matrix(table["y"]) if "y" in table.column_names else None)

    @classmethod
    def make(cls, x, w=None, y=None) -> Local:
        x = np.asarray(x, float)
        x = x[:, None] if x.ndim == 1 else x
        w = np.ones(len(x)) if w is None else np.broadcast_to(np.asarray(w, float), len(x)).copy()
        y = None if y is None else np.asarray(y, float).reshape(len(x), -1)
        return cls(np.arange(len(x)), x, w, y)

    def __len__(self) -> int:
        return len(self.idx)


def points(df: DataFrame, key: str, x: str | list[str | Column], weight: str | Column | None = None, y: str | list[str] | None = None) -> Points:
    """Points from an array column or from scalar columns; a single number is a vector of one."""
    def vector(v):
        if isinstance(v, list):
            return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in v])
        return F.col(v).cast("array<double>") if dict(df.dtypes)[v].startswith("array") else F.array(F.col(v).cast("double"))

    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    return Points(df.select(F.col(key).alias("_idx"), vector(x).alias("x"), w.alias("w"), *([] if y is None else [vector(y).alias("y")])))


def from_arrays(spark: SparkSession, x, w=None, y=None) -> Points:
    local = Local.make(x, w, y)
    rows = [(int(i), [float(v) for v in a], float(b), *([] if local.y is None else [[float(v) for v in local.y[i]]])) for i, a, b in zip(local.idx, local.x, local.w, strict=True)]
    return Points(spark.createDataFrame(rows, "_idx long, x array<double>, w double" + ", y array<double>" * (local.y is not None)))


def read(spark: SparkSession, path: str, key: str, x, weight=None, y=None, format: str = "parquet", **options) -> Points:
    """Points from files of any format that Spark reads; only the named columns are scanned."""
    return points(spark.read.format(format).options(**options).load(path), key, x, weight, y)


def uniform(seed: int, key: str | Column = "_idx") -> Column:
    """A number in [0, 1) from md5 of seed and key: the same on every engine and at every run."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def write(p: Points, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    p.df.write.format(format).mode(mode).save(path)
