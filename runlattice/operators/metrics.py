"""Prediction quality, plain and weighted by how well the experiment performed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY
from runlattice.operators.scoring import small_if_declared

# Fixed values of the importance curve and of the flat-target rule.
FLOOR = 0.1
STEEPNESS = 0.8
TINY = 1e-8


def r_squared(res: Column, tot: Column) -> Column:
    flat = F.when(res > TINY, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(tot < TINY, flat).otherwise(1.0 - res / tot)


def regression_metrics(rows: DataFrame, by: list[str] = ("feature",), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """MAE, R² and n per group in one pass.

    The spread comes from Spark's merged central moments, which keep their precision for
    targets far from 0.
    """
    err = F.col(truth) - F.col(pred)
    n = F.count(err)  # pairs: a row without truth or prediction counts for nothing
    return rows.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        r_squared(F.sum(err * err), F.var_pop(F.when(err.isNotNull(), F.col(truth))) * n).alias("r2"),
        n.alias("n_samples"),
    )


def informed_r2(
    rows: DataFrame, weight: str, by: list[str] = ("feature",), truth: str = "truth", pred: str = "pred"
) -> DataFrame:
    """R², weighted R² (``r2_inf``) and their gap per group; weights are normalised to sum 1."""
    means = rows.groupBy(*by).agg((F.sum(F.col(weight) * F.col(truth)) / F.sum(weight)).alias("_m"), F.sum(weight).alias("_w"))
    w = F.col(weight) / F.col("_w")
    err = F.col(truth) - F.col(pred)
    off = F.col(truth) - F.col("_m")
    n = F.count(F.lit(1))
    out = rows.join(small_if_declared(means, list(by)), list(by)).groupBy(*by).agg(
        r_squared(F.sum(err * err), F.var_pop(truth) * n).alias("r2"),
        r_squared(F.sum(w * err * err), F.sum(w * off * off)).alias("r2_inf"),
        n.alias("n_samples"),
    )
    return out.withColumn("r2_gap", F.col("r2_inf") - F.col("r2"))


def importance(scores: DataFrame, by: str = "perf_code", score: str = "score", name: str = "importance", reference: DataFrame | None = None) -> DataFrame:
    """Sigmoid weight around each score's mean, from FLOOR to 1; flat scores share one weight.

    The mean and spread are those of ``reference`` (default: the scores themselves).
    """
    anchor = (scores if reference is None else reference).groupBy(by).agg(
        F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s")
    )
    k = F.when(F.col("_s") > 1e-10, STEEPNESS / F.col("_s")).otherwise(F.lit(0.0))
    curve = FLOOR + (1 - FLOOR) / (1 + F.exp(-k * (F.col(score) - F.col("_m"))))
    return scores.join(small_if_declared(anchor, [by]), by).withColumn(name, curve).drop("_m", "_s")


def feature_importance(
    experiments: DataFrame, scores: DataFrame, features_of: dict[str, list[str]]
) -> DataFrame:
    """(key, feature, importance) from the scores of the features they evaluate.

    An experiment without a score counts as 0 in that score's curve.
    """
    codes = [p for p in features_of if features_of[p]]
    wanted = experiments.select(KEY, F.explode(F.lit(codes)).alias("perf_code"))
    filled = wanted.join(scores.select(KEY, "perf_code", "score"), [KEY, "perf_code"], "left").fillna(0.0, ["score"])
    weighted = importance(filled)
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f).alias("f")) for p in codes for f in features_of[p]])
    own = F.filter(pairs, lambda x: x.p == F.col("perf_code"))
    return weighted.select(KEY, F.explode(F.transform(own, lambda x: x.f)).alias("feature"), "importance")


def expand_to_rows(rows: DataFrame, per_experiment: DataFrame, value: str, on: list[str] = (KEY,)) -> DataFrame:
    """Carry one value per experiment to its rows, by identity."""
    return rows.join(per_experiment.select(*on, value), list(on))


def validate(predictions: DataFrame, outputs: list[str], stats: dict, weights: DataFrame | None = None) -> DataFrame:
    """Metrics per feature from scaled truth ``<f>`` and prediction ``pred_<f>`` columns.

    Both are brought back to physical units first. No rows is an error. ``weights`` (key, feature,
    importance) adds the weighted R².
    """
    for f in outputs:
        if f in stats:
            predictions = predictions.withColumns(
                {f: stats[f].reverse(F.col(f)), f"pred_{f}": stats[f].reverse(F.col(f"pred_{f}"))}
            )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("truth"), F.col(f"pred_{f}").alias("pred")) for f in outputs])
    )
    long = predictions.select(KEY, pairs.alias("r")).select(KEY, "r.feature", "r.truth", "r.pred")
    if weights is None:
        out = regression_metrics(long)
    else:
        plain = regression_metrics(long)
        informed = informed_r2(long.join(weights, [KEY, "feature"]), "importance").select("feature", "r2_inf")
        out = plain.join(informed, "feature", "left").withColumn("r2_gap", F.col("r2_inf") - F.col("r2"))
    if predictions.isEmpty():
        raise ValueError("no rows to validate")
    return out
