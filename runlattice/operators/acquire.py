"""Ranking candidate experiments by expected performance and coverage gain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.operators.design import snapshot, sobol
from runlattice.operators.evidence import Evidence, with_gain


def blend(perf: Column, gain: Column, kappa: float) -> Column:
    """(1 - κ) P + κ ΔE."""
    if not 0 <= kappa <= 1:
        raise ValueError("kappa must be between 0 and 1")
    if kappa == 0:
        return perf
    if kappa == 1:
        return gain
    return (1 - kappa) * perf + kappa * gain


def acquisition(
    candidates: DataFrame,
    kappa: float,
    perf: Column | Callable[[DataFrame], DataFrame] | None = None,
    fitted: Evidence | dict | None = None,
    weights: dict | None = None,
    perf_range: tuple[float, float] | None = None,
    points: str | None = None,
    name: str = "score",
) -> DataFrame:
    """Add the acquisition score; the part that κ leaves out is not computed at all.

    ``perf`` is an expression or a function that adds a ``perf`` column. With ``perf_range`` it
    is first brought to [0, 1], 0.5 for an empty range.
    """
    out = candidates
    if kappa < 1:
        if perf is None:
            raise ValueError("performance is needed below kappa 1")
        out = out.withColumn("perf", perf) if isinstance(perf, Column) else perf(out)
        if perf_range is not None:
            lo, hi = perf_range
            scaled = (F.col("perf") - lo) / (hi - lo) if hi - lo > 1e-10 else F.lit(0.5)
            out = out.withColumn("perf", scaled)
    if kappa > 0:
        if fitted is None:
            raise ValueError("evidence is needed above kappa 0")
        out = with_gain(out, fitted, weights, points=points)
    parts = [F.col(c) if c in out.columns else F.lit(0.0) for c in ("perf", "gain")]
    return out.withColumn(name, blend(*parts, kappa))


def mean_over_points(scored_points: DataFrame, by: str, score: str = "perf") -> DataFrame:
    """A candidate's performance: the mean over its points."""
    return scored_points.groupBy(by).agg(F.avg(score).alias(score))


def best(scored: DataFrame, k: int, score: str = "score", tie: str = "cand_id") -> DataFrame:
    """The k best candidates; each task keeps its own k, so nothing is sorted as a whole."""
    return scored.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def pool_size(dims: int, n: int = 512) -> int:
    return max(n, 32 * dims)


def refine(top: DataFrame, dims: list[str], n: int, width: float, seed: int = 1, tie: str = "cand_id") -> DataFrame:
    """A second pool: n points around each of the best, within ``width`` and the unit box."""
    around = top.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = {
        d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(d) + (sobol(F.col("_i"), k, seed) - 0.5) * width))
        for k, d in enumerate(dims)
    }
    return around.withColumns(moved).select((F.col(tie) * n + F.col("_i")).alias(tie), F.col(tie).alias("start"), *dims)


def discover(pool: DataFrame, fitted: Evidence, n: int, tie: str = "cand_id") -> DataFrame:
    """n experiments that together gain most coverage, found greedily.

    Each round scores the whole pool and takes the best; that one row goes back as a pending
    point. The evidence is small whatever the data, so no round builds on the plan of another.
    """
    spark = pool.sparkSession
    dims = list(fitted.dims)
    chosen = []
    for rank in range(n):
        top = best(with_gain(pool, fitted).select(tie, *dims, "gain"), 1, "gain", tie).first()
        if top is None:
            break
        chosen.append((rank, top[tie], *[float(top[d]) for d in dims], float(top["gain"])))
        fitted = fitted.with_points(np.array([[top[d] for d in dims]], dtype=float), np.ones(1))
    kind = pool.schema[tie].dataType.simpleString()
    return spark.createDataFrame(
        chosen, ", ".join(["rank int", f"{tie} {kind}", *[f"{d} double" for d in dims], "gain double"])
    )


def propose(
    pool: DataFrame, kappa: float | None = None, perf: Column | None = None, fitted: Evidence | dict | None = None, **settings
) -> DataFrame:
    """The next experiment: the best of the pool, with the record of how it was chosen."""
    kappa = 0.5 if kappa is None else kappa
    source = "inference_step" if kappa == 0 else "exploration_step"
    top = best(acquisition(pool, kappa, perf, fitted), 1)
    return top.withColumn("source", F.lit(source)).withColumn("config_snapshot", snapshot(source, kappa=float(kappa), **settings))
