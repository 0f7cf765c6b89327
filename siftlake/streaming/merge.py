"""An extension: a coreset kept up to date over a stream by merge and reduce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.solvers import MapReduce, Solver
from siftlake.sources.points import Points
from siftlake.sources.tables import finished


class MergeReduce:
    """A foreachBatch sink: each micro-batch is reduced on its own, then together with what was kept.

    The kept points live in Parquet folders, one for each batch id.  A batch starts from the finished folder with the
    largest id below its own, so a batch that is run again, also by a new driver, starts from the same one and writes
    the same folder.  The kept weights add up to the weight of all points seen.
    """

    def __init__(self, solver: Solver | MapReduce, path: str):
        self.solver, self.path = solver, path.rstrip("/")

    def _last(self, spark, below: int | None = None) -> str | None:
        ids = [int(name) for name in finished(spark, self.path) if name.isdecimal()]
        ids = [i for i in ids if below is None or i < below]
        return f"{self.path}/{max(ids)}" if ids else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        new = self._reduced(batch)
        before = self._last(batch.sparkSession, batch_id)
        if before is not None:
            new = self._reduced(new.unionByName(batch.sparkSession.read.parquet(before)))
        new.write.mode("overwrite").parquet(f"{self.path}/{batch_id}")

    def _reduced(self, df: DataFrame) -> DataFrame:
        size = self.solver.base.size if isinstance(self.solver, MapReduce) else self.solver.size
        n, total = df.agg(F.count("*"), F.sum("w")).first()
        if n <= size:
            return df
        kept = self.solver.reduce(Points(df)).points().df.drop("pos")
        return kept.select(*[c for c in df.columns if c != "w"], F.lit(total / size).alias("w")).select(*df.columns)

    def points(self, spark) -> Points:
        return Points(spark.read.parquet(self._last(spark)))
