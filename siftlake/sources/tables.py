"""Tables written in the shared folder, to cut lineage or to pass a result on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process (tests, one machine), a folder made once for the session."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the master is {context.master}")
        found = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.checkpoint.dir", found)
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/siftlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read again from a table in the shared folder: lost executors cost no more than a read."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() on which nothing that is still read depends."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def drop_all(spark: SparkSession) -> None:
    """Deletes every table and file that operators have left in the shared folder; call it once results are written elsewhere."""
    delete(spark, f"{folder(spark)}/siftlake")


def _hadoop(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, where: str) -> None:
    store, path = _hadoop(spark, where)
    store.delete(path, True)


def finished(spark: SparkSession, where: str) -> list[str]:
    """Names of the tables below a folder that were written to their end."""
    store, path = _hadoop(spark, where)
    if not store.exists(path):
        return []
    inside = [s.getPath() for s in store.listStatus(path) if s.isDirectory()]
    return sorted(p.getName() for p in inside if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
