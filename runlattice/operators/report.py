"""Tables behind reports: error grids, optima, slices, evolutions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.operators.asof import effective_params
from runlattice.schema import Axis


def error_grid(truth: DataFrame, predicted: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Absolute error per cell."""
    return truth.select(*on, F.col(value).alias("truth")).join(
        predicted.select(*on, F.col(value).alias("pred")), on
    ).withColumn("error", F.abs(F.col("truth") - F.col("pred")))


def mean_error(errors: DataFrame, by: list[str]) -> DataFrame:
    return errors.groupBy(*by).agg(F.avg("error").alias("mean_error"))


def grid_optima(grid: DataFrame, x: str, y: str, metrics: dict[str, Column]) -> DataFrame:
    """Best cell per metric; a tie goes to the lowest cell in row-major order."""
    best = grid.agg(
        *[
            F.max(F.when(c.isNotNull(), F.struct(c.alias("v"), (-F.col(x)).alias("nx"), (-F.col(y)).alias("ny")))).alias(m)
            for m, c in metrics.items()
        ]
    )
    rows = [
        F.struct(F.lit(m).alias("metric"), (-F.col(f"{m}.nx")).alias(x), (-F.col(f"{m}.ny")).alias(y), F.col(f"{m}.v").alias("value"))
        for m in metrics
    ]
    return best.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def slice_nearest(grid: DataFrame, x: str, at: float) -> DataFrame:
    """Cells of the grid line nearest to a value; the lower line on a tie."""
    near = grid.agg(F.min(F.struct(F.abs(F.col(x) - at).alias("d"), F.col(x).alias("x"))).alias("n")).select("n.x").scalar()
    return grid.where(F.col(x) == near)


def parallel_rows(df: DataFrame, key: str, bounds: dict[str, tuple[float, float] | None]) -> DataFrame:
    """(key, param, position in [0, 1]); 0.5 without bounds."""
    parts = []
    for c, ends in bounds.items():
        if ends is None or ends[1] == ends[0]:
            at = F.lit(0.5)
        else:
            at = (F.col(c).cast("double") - ends[0]) / (ends[1] - ends[0])
        parts.append(F.struct(F.lit(c).alias("param"), at.alias("position")))
    return df.select(key, F.explode(F.array(*parts)).alias("r")).select(key, "r.param", "r.position")


def trust_mask(df: DataFrame, evidence: str, threshold: float) -> DataFrame:
    """How far evidence reaches a threshold, cut to [0, 1], and whether it does."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(evidence) / threshold))
    return df.withColumns({"trust": share, "trusted": F.col(evidence) >= threshold})


def evolution(members: DataFrame, values: DataFrame, rounds: list[int], value: str, by: str = "set_code") -> DataFrame:
    """Per set and round k: size, mean and best of its first k members, on shared ends.

    Each member is added up once, in the first round that holds it; rounds accumulate the sums.
    """
    ks = sorted(rounds)
    first = reduce(lambda acc, k: acc.when(F.col("pos") < k, k), ks, F.when(F.lit(False), 0))
    rows = members.join(values, "exp_code").withColumn("round", first).where("round IS NOT NULL")
    sums = rows.groupBy(by, "round").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.max(value).alias("hi"), F.min(value).alias("lo")
    )
    full = sums.select(by).distinct().withColumn("round", F.explode(F.lit(ks))).join(sums, [by, "round"], "left")
    along = Window.partitionBy(by).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    out = full.select(
        by, "round", F.sum("n").over(along).alias("n_members"),
        (F.sum("s").over(along) / F.sum("n").over(along)).alias("mean"), F.max("hi").over(along).alias("best"),
    )
    ends = sums.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.withColumns({"shared_min": ends.select("lo").scalar(), "shared_max": ends.select("hi").scalar()}).where(
        "n_members IS NOT NULL"
    )


def trajectory_points(experiments: DataFrame, updates: DataFrame, axis: Axis, params: list[str]) -> DataFrame:
    """Parameters at each step of one axis, updates applied."""
    return effective_params(experiments, updates, [axis], params)


def best_starts(history: DataFrame, start: str = "start", objective: str = "objective") -> tuple[DataFrame, DataFrame]:
    """Lowest objective of each start, and the start that holds the lowest of all."""
    low = history.groupBy(start).agg(F.min(objective).alias("lowest"))
    top = low.agg(F.min(F.struct("lowest", F.col(start).alias("s"))).alias("b")).select(
        F.col("b.s").alias(start), F.col("b.lowest").alias("lowest")
    )
    return low, top


def ranked_starts(low: DataFrame, start: str = "start") -> DataFrame:
    """Mark the best start among all."""
    _, top = best_starts(low.withColumnRenamed("lowest", "objective"), start)
    return low.withColumn("is_best", F.col(start) == top.select(start).scalar())


def metric_table(metrics: DataFrame, columns: list[str] = ("mae", "r2", "n_samples"), features: list[str] | None = None) -> DataFrame:
    """One row per metric, one column per feature; with the declared names given, they need not be looked up first."""
    long = metrics.unpivot(["feature"], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value")
    return long.groupBy("metric").pivot("feature", features).agg(F.max("value"))
