"""Approximate Gram row means: a regression on kernels to few points instead of all pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siftlake.functions.kernels import Kernel
from siftlake.operators import pairwise
from siftlake.sources.points import Local, Points, uniform

#: Points, the least similar to the landmarks there are, that one pass over all sends to the driver.
FARTHEST = 4096


def sample(p: Points, m: int, seed: int) -> Local:
    """m points by a hash of _idx; all if there are fewer."""
    return Local.of(p.df.orderBy(uniform(seed), "_idx").limit(m).toArrow())


@dataclass(frozen=True)
class Approximate:
    base: Kernel
    kernel_points: int = 10_000
    train_points: int = 10_000
    seed: int = 0

    def __post_init__(self):
        if self.kernel_points < 1 or self.train_points < 1:
            raise ValueError(f"kernel_points is {self.kernel_points} and train_points {self.train_points}; both are 1 or more")

    def landmarks(self, p: Points) -> np.ndarray:
        raise NotImplementedError

    def targets(self, train: np.ndarray, p: Points) -> np.ndarray:
        """The full means at the training points: all points pass once, in Arrow batches."""
        shared, kernel = p.df.sparkSession.sparkContext.broadcast(train), self.base

        def run(batches):
            total, mass = np.zeros(len(shared.value)), 0.0
            for batch in batches:
                if batch.num_rows:
                    w = np.asarray(batch.column(1))
                    total += kernel(shared.value, pairwise.matrix(batch.column(0))) @ w
                    mass += w.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([mass])], ["total", "mass"])

        rows = p.df.select("x", "w").mapInArrow(run, "total binary, mass double").toLocalIterator()
        total, mass = np.zeros(len(train)), 0.0
        for r in rows:
            total, mass = total + np.frombuffer(r.total), mass + r.mass
        return total / mass

    def gramian_row_mean(self, p: Points) -> DataFrame:
        """(_idx, mean)."""
        marks, train = self.landmarks(p), self.training(p)
        solution = np.linalg.lstsq(self.base(train, marks), self.targets(train, p), rcond=None)[0]
        shared, kernel = p.df.sparkSession.sparkContext.broadcast((marks, solution)), self.base

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    marks, solution = shared.value
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernel(pairwise.matrix(batch.column(1)), marks) @ solution)], ["_idx", "mean"])

        return p.df.select("_idx", "x").mapInArrow(run, f"_idx {dict(p.df.dtypes)['_idx']}, mean double")

    def training(self, p: Points) -> np.ndarray:
        return sample(p, self.train_points, self.seed + 1).x


class MonteCarlo(Approximate):
    """Landmarks drawn at random."""

    def landmarks(self, p):
        return sample(p, self.kernel_points, self.seed).x


class ANNchor(Approximate):
    """Landmarks one by one: next comes the point of all that is least similar to those there are; the smallest _idx begins and wins ties.

    Similarities only rise with more landmarks.  So one pass over all points gives the least similar ones, and
    these give the next landmarks for as long as one of them is below the last: no other point can come before.
    """

    def landmarks(self, p):
        first = Local.of(p.df.orderBy("_idx").limit(1).toArrow())
        x, chosen = first.x, first.idx.tolist()
        while chosen and len(chosen) < self.kernel_points:
            rows = self.farthest(p, x, chosen).orderBy("near", "_idx").limit(FARTHEST).toArrow()
            if not rows.num_rows:
                break
            own, near = Local.of(rows), rows["near"].to_numpy().copy()
            last = len(own) - 1 if len(own) == FARTHEST else None
            bound = np.inf if last is None else near[last]
            order = np.argsort(own.idx, kind="stable")  # so that argmin takes the smallest _idx
            left = np.ones(len(own), bool)
            while len(chosen) < self.kernel_points and left.any():
                at = order[np.argmin(np.where(left, near, np.inf)[order])]
                if near[at] > bound or near[at] == bound and last is not None and own.idx[at] > own.idx[last]:
                    break
                left[at] = False
                chosen.append(own.idx[at].item())
                x = np.concatenate((x, own.x[at : at + 1]))
                near = np.maximum(near, self.base(own.x, own.x[at : at + 1])[:, 0])
        return x

    def farthest(self, p: Points, x: np.ndarray, chosen: list) -> DataFrame:
        """(_idx, x, w, near): the points that are not chosen, each with its largest similarity to the landmarks x."""
        kind = dict(p.df.dtypes)["_idx"]
        shared, kernel = p.df.sparkSession.sparkContext.broadcast((x, chosen)), self.base

        def run(batches):
            marks, chosen = shared.value
            for batch in batches:
                batch = batch.filter(pc.invert(pc.is_in(batch.column(0), pa.array(chosen, batch.column(0).type))))
                if batch.num_rows:
                    rows = pairwise.matrix(batch.column(1))
                    near = np.full(len(rows), -np.inf)
                    for lo in range(0, len(marks), 256):
                        near = np.maximum(near, kernel(rows, marks[lo : lo + 256]).max(1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["_idx", "x", "w", "near"])

        return p.df.select("_idx", "x", "w").mapInArrow(run, f"_idx {kind}, x array<double>, w double, near double")


class Nystrom(Approximate):
    """The landmarks are also the training points, with means over themselves."""

    def landmarks(self, p):
        return sample(p, self.kernel_points, self.seed).x

    def training(self, p):
        return self.landmarks(p)

    def targets(self, train, p):
        return self.base(train, train).mean(1)
