"""Solvers by name, set up for one table of points, to compare them at equal sizes."""

from __future__ import annotations

from collections.abc import Callable

from siftlake.functions.kernels import PCIMQ, SquaredExponential
from siftlake.operators import pairwise, solvers
from siftlake.operators.score import kde_score
from siftlake.sources.points import Local, Points, uniform

#: Points whose distances set the length scale, and whose density gives the score.
SCALE_POINTS = 300


def solver_set(p: Points, d: int, g: int = 4, leaf_size: int | None = None, seed: int = 45) -> dict[str, Callable[[int], object]]:
    """name -> function of the size; with a leaf_size the greedy ones work by MapReduce.

    The length scale is the median heuristic's on SCALE_POINTS points by hash.
    """
    few = Points(p.df.orderBy(uniform(seed), "_idx").limit(SCALE_POINTS))
    scale = float(pairwise.median_heuristic(few, d).first()[0])
    kernel, sample = SquaredExponential(scale), Local.of(few.df.toArrow()).x

    def reduced(make: Callable[[int], solvers.Solver]) -> Callable[[int], object]:
        return make if leaf_size is None else lambda m: solvers.MapReduce(make(m), leaf_size, warn=False)

    def iterated(temperatures: Callable[[int], list[float]] | None) -> Callable[[int], object]:
        return lambda m: solvers.IterativeKernelHerding(m, kernel, probabilistic=temperatures is not None, seed=seed, iterations=5, temperatures=temperatures(m) if temperatures else None)

    return {
        "KernelHerding": reduced(lambda m: solvers.KernelHerding(m, kernel)),
        "SteinThinning": reduced(lambda m: solvers.SteinThinning(m, PCIMQ(scale), kde_score(sample, scale), regularise=False)),
        "RandomSample": lambda m: solvers.RandomSample(m, seed=seed),
        "RPCholesky": lambda m: solvers.RPCholesky(m, kernel, seed=seed),
        "KernelThinning": reduced(lambda m: solvers.KernelThinning(m, kernel, kernel.sqrt_kernel(d), seed=seed)),
        "CompressPlusPlus": lambda m: solvers.CompressPlusPlus(g, m, kernel, kernel.sqrt_kernel(d), seed=seed),
        "IterativeHerding": iterated(None),
        "ProbabilisticIterativeHerding": iterated(lambda m: [1e-3] * 5),
    }


def discrepancies(p: Points, d: int, sizes: list[int], **options) -> dict[str, dict[int, float]]:
    """MMD of each solver's coreset at each size."""
    made, kernel = solver_set(p, d, **options), None
    kernel = made["KernelHerding"](1)
    kernel = getattr(kernel, "base", kernel).kernel
    return {name: {m: round(make(m).reduce(p).mmd(kernel), 6) for m in sizes} for name, make in made.items()}
