"""Experiment-level cross-validation, and what its errors mean.

Least squares only needs sums of products. They are added up once per fold; what a fold's
model is trained on is the total minus its own sums, so k models cost one pass over the rows,
also when every experiment is its own fold. Models of any other kind are fitted once per fold
(`held_out`): rows are written once, a directory per fold, and several folds are fitted at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.functions.quantiles import exact_quantiles
from runlattice.operators.grid import KEY
from runlattice.operators.metrics import regression_metrics
from runlattice.operators.models import Fitted, ModelSpec, fit, predict
from runlattice.operators.prep import fit_norm
from runlattice.session import shared_folder

# The four readings of an error against its coverage.
LABELS = ("model_problem", "under_explored", "trustworthy", "sparse_ok")

#: Folds that `held_out` fits a model for, at most.
MAX_FOLDS = 100


def _centers(rows: DataFrame, inputs: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and spread of each input; products of centred values keep their digits."""
    row = rows.agg(*[f(c).alias(f"{n}_{c}") for c in inputs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in inputs}


def _basis(inputs: list[str], centers: dict) -> list[Column]:
    return [F.lit(1.0), *[(F.col(c) - centers[c][0]) / centers[c][1] for c in inputs]]


def _sums(inputs: list[str], targets: list[str], centers: dict) -> dict[str, Column]:
    b = _basis(inputs, centers)
    n = len(b)
    out = {f"x{i}_{j}": F.sum(b[i] * b[j]) for i in range(n) for j in range(i, n)}
    out.update({f"y{t}_{i}": F.sum(b[i] * F.col(c)) for t, c in enumerate(targets) for i in range(n)})
    return out


def _solve(part: pd.DataFrame, n: int, targets: int, total: dict | None) -> np.ndarray:
    """Coefficients (rows, targets, n) of many small systems at once."""

    def col(name):
        own = part[name].to_numpy(dtype=float)
        return own if total is None else total[name] - own

    a = np.empty((len(part), n, n))
    for i in range(n):
        for j in range(i, n):
            a[:, i, j] = a[:, j, i] = col(f"x{i}_{j}")
    out = np.empty((len(part), targets, n))
    for t in range(targets):
        y = np.stack([col(f"y{t}_{i}") for i in range(n)], axis=1)
        try:
            out[:, t] = np.linalg.solve(a, y[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            # Inputs that do not vary in some training set: the shortest solution.
            out[:, t] = (np.linalg.pinv(a, hermitian=True) @ y[:, :, None])[:, :, 0]
    return out


def fold_models(
    rows: DataFrame, fold: str, inputs: list[str], targets: list[str], centers: dict, k: int | None = None
) -> DataFrame:
    """(fold, coef: array per target) of the models trained without each fold.

    The sums of k folds are k rows and are solved at once; without k they stay distributed.
    """
    sums = _sums(inputs, targets, centers)
    per_fold = rows.groupBy(fold).agg(*[c.alias(name) for name, c in sums.items()])
    n, m = len(inputs) + 1, len(targets)
    kind = rows.schema[fold].dataType.simpleString()
    if k is not None:
        few = per_fold.toPandas()
        if len(few) < 2:
            raise ValueError("cross-validation needs at least two folds with rows")
        coef = _solve(few, n, m, {c: few[c].sum() for c in sums})
        table = [(f, c.tolist()) for f, c in zip(few[fold].tolist(), coef)]
        return rows.sparkSession.createDataFrame(table, f"{fold} {kind}, coef array<array<double>>")
    total = rows.agg(*[c.alias(name) for name, c in sums.items()]).first().asDict()

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            coef = _solve(part, n, m, total)
            yield pd.DataFrame({fold: part[fold], "coef": [c.tolist() for c in coef]})

    return per_fold.mapInPandas(solve, f"{fold} {kind}, coef array<array<double>>")


def _predicted(inputs: list[str], centers: dict, coef: Column) -> Column:
    b = _basis(inputs, centers)
    return reduce(lambda a, v: a + v, [F.get(coef, F.lit(i)) * b[i] for i in range(len(b))])


def cross_validate(
    rows: DataFrame, folds: DataFrame, inputs: list[str], targets: list[str], k: int | None = None
) -> DataFrame:
    """(key, feature, mae, r2, n_samples) of each held-out experiment.

    ``rows`` are training rows without missing values, ``folds`` gives (key, fold). The models of
    k folds are a small table; without k there is one per experiment and they join by fold.
    """
    if k is not None and k < 2:
        raise ValueError("cross-validation needs at least two folds")
    if k is None and folds.limit(2).count() < 2:
        raise ValueError("cross-validation needs at least two experiments")
    held = rows.join(folds, KEY)
    centers = _centers(rows, inputs)
    models = fold_models(held, "fold", inputs, targets, centers, k)
    scored = held.join(F.broadcast(models) if k is not None else models, "fold")
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("feature"), F.col(t).cast("double").alias("truth"),
                    _predicted(inputs, centers, F.get("coef", F.lit(i))).alias("pred"),
                )
                for i, t in enumerate(targets)
            ]
        )
    )
    long = scored.select(KEY, pairs.alias("r")).select(KEY, "r.feature", "r.truth", "r.pred")
    return regression_metrics(long, [KEY, "feature"])


def held_out(
    rows: DataFrame, folds: DataFrame, specs: list[ModelSpec], norm: dict[str, str] | None = None,
    vocab: dict[str, list[str]] | None = None, together: int = 4,
) -> DataFrame:
    """The rows with their ``fold`` and ``pred_<output>``, each from models that have not seen its fold.

    ``folds`` gives (key, fold), in 2 to ``MAX_FOLDS`` folds; rows without a fold are left out. ``norm`` names
    the scaling of inputs and outputs, by statistics of the training rows alone. ``together`` folds are fitted at a time.
    """
    spark = rows.sparkSession
    joined = rows.drop("fold").join(folds.where("fold IS NOT NULL").select(KEY, "fold"), KEY)
    path = shared_folder(spark, "folds")
    joined.write.partitionBy("fold").parquet(path)
    held = spark.read.schema(joined.schema).parquet(path)
    names = sorted(r.fold for r in held.select("fold").distinct().limit(MAX_FOLDS + 1).collect())
    if not 2 <= len(names) <= MAX_FOLDS:
        raise ValueError(f"cross-validation of models needs 2 to {MAX_FOLDS} folds with rows")
    outputs = {o for s in specs for o in s.outputs}

    def one(name) -> Fitted:
        train = held.where(F.col("fold") != F.lit(name))
        x = fit_norm(train, {c: m for c, m in (norm or {}).items() if c not in outputs})
        y = fit_norm(train, {c: m for c, m in (norm or {}).items() if c in outputs}, "y")
        return fit(specs, train, x, y, vocab)

    with ThreadPool(min(together, len(names))) as pool:
        tasks = [inheritable_thread_target(spark)(partial(one, n)) for n in names]
        fitted = pool.map(lambda task: task(), tasks, chunksize=1)
    return reduce(DataFrame.unionByName, [predict(held.where(F.col("fold") == F.lit(n)), f) for n, f in zip(names, fitted)])


def experiment_errors(predictions: DataFrame, outputs: list[str]) -> DataFrame:
    """(key, feature, mae, r2, n_samples) from ``<output>`` and ``pred_<output>``; metrics.validate gives them per feature,
    and the weighted R²."""
    pairs = F.array(*[F.struct(F.lit(o).alias("feature"), F.col(o).cast("double").alias("truth"), F.col(f"pred_{o}").alias("pred")) for o in outputs])
    long = predictions.select(KEY, F.explode(pairs).alias("r")).select(KEY, "r.feature", "r.truth", "r.pred")
    return regression_metrics(long, [KEY, "feature"])


def error_field(errors: DataFrame, params: DataFrame, feature: str, metric: str = "mae") -> DataFrame:
    """Parameters and error of each held-out experiment for one feature."""
    own = errors.where(F.col("feature") == feature).select(KEY, F.col(metric).alias("error"))
    return params.join(own, KEY)


def error_features(errors: DataFrame) -> DataFrame:
    return errors.select("feature").distinct()


def pooled(errors: DataFrame, metric: str = "mae") -> DataFrame:
    """Sample-weighted mean error per feature."""
    return errors.groupBy("feature").agg(
        (F.sum(F.col(metric) * F.col("n_samples")) / F.sum("n_samples")).alias(f"{metric}_mean"),
        F.count(F.lit(1)).alias("n_experiments"),
        F.sum("n_samples").alias("n_samples"),
    )


def stage_errors(
    members: DataFrame, rows: DataFrame, probe: DataFrame, stages: list[int], inputs: list[str], targets: list[str]
) -> DataFrame:
    """(stage, feature, mae, r2, n_samples): models of the first k members, scored on a probe set.

    ``members`` gives (key, pos), ``probe`` keys. All stages come from one pass: each row goes to
    the first stage that holds it and the sums of earlier stages are added on.
    """
    ks = sorted(stages)
    if not ks:
        raise ValueError("no stages")
    first = reduce(lambda acc, i: acc.when(F.col("pos") < ks[i], i), range(len(ks)), F.when(F.lit(False), -1))
    train = rows.join(members.select(KEY, "pos"), KEY).withColumn("_s", first).where("_s IS NOT NULL")
    centers = _centers(rows, inputs)
    sums = _sums(inputs, targets, centers)
    per = train.groupBy("_s").agg(*[c.alias(c_name) for c_name, c in sums.items()])
    along = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    running = per.select("_s", *[F.sum(c).over(along).alias(c) for c in sums]).toPandas()
    if running.empty:
        raise ValueError("no experiment to train on")
    coef = _solve(running, len(inputs) + 1, len(targets), None)
    have = {int(s): coef[i] for i, s in enumerate(running["_s"])}
    last, table = None, []
    for i, k in enumerate(ks):
        last = have.get(i, last)
        if last is not None:
            table.append((k, last))
    test = rows.join(probe.select(KEY), KEY, "left_semi")
    pairs = [
        F.struct(
            F.lit(k).alias("stage"), F.lit(t).alias("feature"), F.col(t).cast("double").alias("truth"),
            _predicted(inputs, centers, F.lit([float(v) for v in c[j]])).alias("pred"),
        )
        for k, c in table
        for j, t in enumerate(targets)
    ]
    long = test.select(F.explode(F.array(*pairs)).alias("r")).select("r.stage", "r.feature", "r.truth", "r.pred")
    return regression_metrics(long, ["stage", "feature"])


def diagnose(
    errors: DataFrame, coverage: DataFrame, metric: str = "mae",
    error_threshold: float | None = None, coverage_threshold: float | None = None,
) -> DataFrame:
    """(key, feature, error, coverage, label, thresholds); cuts default to the medians."""
    both = errors.select(KEY, "feature", F.col(metric).alias("error")).join(coverage.select(KEY, "coverage"), KEY)
    need = [c for c, t in (("error", error_threshold), ("coverage", coverage_threshold)) if t is None]
    if need:
        cuts = exact_quantiles(both, need, [0.5])
        if any(cuts[c] is None for c in need):
            return both.withColumns({"label": F.lit(None).cast("string")})
        error_threshold = cuts["error"][("q", 0.5)] if "error" in need else error_threshold
        coverage_threshold = cuts["coverage"][("q", 0.5)] if "coverage" in need else coverage_threshold
    wrong, known = F.col("error") >= error_threshold, F.col("coverage") >= coverage_threshold
    label = (
        F.when(wrong & known, LABELS[0]).when(wrong, LABELS[1]).when(known, LABELS[2]).otherwise(F.lit(LABELS[3]))
    )
    return both.withColumn("label", label)


def label_summary(diagnosed: DataFrame) -> DataFrame:
    """Points per label, zeros included."""
    counts = diagnosed.agg(*[F.count_if(F.col("label") == name).alias(name) for name in LABELS])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("n")) for n in LABELS])).alias("r")
    ).select("r.label", "r.n")
