"""Packed numpy columns, and passes over texts; tables in the shared folder are those of siftlake.sources.tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.sources.tables import discard, drop_all, folder, fresh, written

__all__ = ["discard", "drop_all", "folder", "fresh", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(value, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, dtype)


BUCKETS = "bucket int, keys binary, values binary"


def bucketed(keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Entries dealt out by key, all of a bucket as one row of two packed columns; keys are well-mixed."""
    with np.errstate(over="ignore"):
        to = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(to.astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")
    keys, values = keys[order], values[order]
    edge = np.searchsorted(to[order], np.arange(buckets + 1).astype(np.uint64))
    for b in range(buckets):
        if edge[b] < edge[b + 1]:
            yield b, pack(keys[edge[b] : edge[b + 1]]), pack(values[edge[b] : edge[b + 1]])


def bucket_rows(rows) -> pa.RecordBatch:
    b, k, v = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(v, pa.binary())], ["bucket", "keys", "values"])


def counts_of(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often (or with what weight) each stands there."""
    if weight is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(keys))) if weight is None else (np.add.reduceat(weight, at) if len(at) else np.zeros(0, np.int64))
    return keys[at], n.astype(np.int64)


def by_bucket(batches, kinds: tuple) -> Iterator[tuple[int, list]]:
    """(bucket, columns) of rows that are sorted by bucket: each column unpacked and joined, or without a kind the list of its packed values."""
    now, held = None, []

    def done():
        columns = list(zip(*held, strict=True))
        return now, [list(c) if kind is None else np.concatenate([unpack(x, kind) for x in c]) for c, kind in zip(columns, kinds, strict=True)]

    for batch in batches:
        for b, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if b != now:
                if held:
                    yield done()
                now, held = b, []
            held.append(row)
    if held:
        yield done()


def release() -> None:
    """Gives the worker's freed memory back: workers are used again by later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def deal(df: DataFrame, column: str = "bucket") -> DataFrame:
    return df.repartition(partitions(df.sparkSession), F.col(column))


def annotate(df: DataFrame, text: str, function: Callable[[pa.Array], list[pa.Array]], schema: str, keep: list[str] | None = None, limit: int = 1 << 18) -> DataFrame:
    """Columns (row, *schema): row is a struct of the kept columns, so that no name of the input can clash.

    A comma inside a type of the schema is written as \\x1f.  function gets runs of about `limit` bytes of whole texts and returns one array for each column of the schema.
    """
    from siftlake.llm.text import slices

    keep = list(df.columns if keep is None else keep)
    kept = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)])
    given = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("t"))
    names = [x.split()[0] for x in schema.split(",")] if schema else []
    out_schema = ", ".join([*(f"k{i} {t}" for i, (_, t) in enumerate(kept.dtypes)), *(f"r{i} {x.split(None, 1)[1]}" for i, x in enumerate(y.strip() for y in schema.split(",")))]).replace("\x1f", ", ")
    n = len(keep)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", limit):
                made = function(part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], [*part.schema.names[:n], *(f"r{i}" for i in range(len(made)))])
        release()

    out = given.mapInArrow(run, out_schema)
    return out.select(F.struct(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]).alias("row"), *[F.col(f"r{i}").alias(c.strip()) for i, c in enumerate(names)])
