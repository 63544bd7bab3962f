"""Fitting and applying prediction models as Spark jobs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY
from runlattice.operators.prep import Stats, category_index, fill_inputs, stats_from_table, stats_table
from runlattice.operators.scoring import score_candidates

KINDS = {
    "linear": lambda **p: LinearRegression(solver="normal", **p),
    "gbt": lambda **p: GBTRegressor(**{"seed": 0, **p}),
    "forest": lambda **p: RandomForestRegressor(**{"seed": 0, **p}),
}


@dataclass(frozen=True)
class ModelSpec:
    """One model: inputs to outputs. Inputs may be outputs of another model.

    ``kind`` names a Spark ML regressor, or ``formula`` gives a column per output in physical units.
    """

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    kind: str = "linear"
    formula: dict[str, Column] | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Fitted:
    """Fitted models in the order they apply, with the scaling of inputs and outputs."""

    specs: list[ModelSpec]
    models: dict[str, PipelineModel]
    x_stats: dict[str, Stats]
    y_stats: dict[str, Stats]
    vocab: dict[str, list[str]] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        return [o for s in self.specs for o in s.outputs]

    @property
    def inputs(self) -> list[str]:
        made = set(self.outputs)
        return list(dict.fromkeys(i for s in self.specs for i in s.inputs if i not in made))


def in_order(specs: list[ModelSpec]) -> list[ModelSpec]:
    """Models after those whose outputs they read."""
    left, made, out = list(specs), set(), []
    produced = {o for s in specs for o in s.outputs}
    while left:
        ready = [s for s in left if all(i in made or i not in produced for i in s.inputs)]
        if not ready:
            raise ValueError("models depend on each other in a circle")
        out += ready
        made |= {o for s in ready for o in s.outputs}
        left = [s for s in left if s not in ready]
    return out


def _scaled(df: DataFrame, columns: list[str], x: dict[str, Stats], y: dict[str, Stats], prefix: str) -> DataFrame:
    """Input columns as the models see them, under new names."""
    stats = {**y, **x}
    return df.withColumns(
        {f"{prefix}{c}": stats[c].forward(F.col(c).cast("double")) if c in stats else F.col(c).cast("double") for c in columns}
    )


def encode(rows: DataFrame, vocab: dict[str, list[str]], unknown: str = "zero") -> DataFrame:
    return rows.withColumns({c: category_index(F.col(c), v, unknown).cast("double") for c, v in vocab.items() if c in rows.columns})


def fit(
    specs: list[ModelSpec], train: DataFrame, x_stats: dict[str, Stats], y_stats: dict[str, Stats],
    vocab: dict[str, list[str]] | None = None,
) -> Fitted:
    """Fit every output in dependency order; no rows is an error.

    ``train`` holds physical values, categories as labels. Rows that miss a target are left out
    for that target alone.
    """
    ordered = in_order(specs)
    vocab = vocab or {}
    out = Fitted(ordered, {}, x_stats, y_stats, vocab)
    rows = encode(train, vocab)
    plain = [c for c in out.inputs if c not in vocab]
    used = list(dict.fromkeys([*out.inputs, *out.outputs]))
    # Every model and output reads the rows again; they are kept (with their lineage) in between.
    rows = fill_inputs(rows, plain).select(*[c for c in used if c in {*rows.columns, *plain}]).persist()
    try:
        if rows.isEmpty():
            raise ValueError("no training rows")
        _fit_all(out, rows)
    finally:
        rows.unpersist()
    return out


def _fit_all(out: Fitted, rows: DataFrame) -> None:
    ordered, x_stats, y_stats = out.specs, out.x_stats, out.y_stats
    for spec in ordered:
        if spec.formula is not None:
            continue
        seen = _scaled(rows, list(spec.inputs), x_stats, y_stats, "_in_")
        for target in spec.outputs:
            label = y_stats[target].forward(F.col(target)) if target in y_stats else F.col(target)
            known = seen.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn("_label", label.cast("double"))
            for i in spec.inputs:
                known = known.where(F.col(f"_in_{i}").isNotNull())
            stages = [
                VectorAssembler(inputCols=[f"_in_{i}" for i in spec.inputs], outputCol=f"_x_{target}"),
                KINDS[spec.kind](featuresCol=f"_x_{target}", labelCol="_label", predictionCol=f"_p_{target}", **spec.options),
            ]
            out.models[target] = Pipeline(stages=stages).fit(known)


def predict(rows: DataFrame, fitted: Fitted, prefix: str = "pred_", unknown: str = "zero") -> DataFrame:
    """Add ``<prefix><output>`` in physical units; upstream predictions feed later models."""
    seen = {}
    for c in fitted.inputs:
        if c not in rows.columns:
            seen[c] = F.lit(0.0)
        elif c in fitted.vocab:
            seen[c] = category_index(F.col(c), fitted.vocab[c], unknown).cast("double")
        else:
            seen[c] = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    df = rows.withColumns({f"_raw_{c}": e for c, e in seen.items()})
    source = {c: f"_raw_{c}" for c in seen}
    stats = {**fitted.y_stats, **fitted.x_stats}
    for spec in fitted.specs:
        if spec.formula is not None:
            df = df.withColumns({f"{prefix}{o}": spec.formula[o].cast("double") for o in spec.outputs})
        else:
            feed = {}
            for i in spec.inputs:
                v = F.col(source[i])
                feed[f"_in_{i}"] = stats[i].forward(v) if i in stats else v
            df = df.withColumns(feed)
            for o in spec.outputs:
                df = fitted.models[o].transform(df)
                back = fitted.y_stats[o].reverse(F.col(f"_p_{o}")) if o in fitted.y_stats else F.col(f"_p_{o}")
                df = df.withColumn(f"{prefix}{o}", back).drop(f"_x_{o}", f"_p_{o}")
            df = df.drop(*feed)
        source.update({o: f"{prefix}{o}" for o in spec.outputs})
    return df.drop(*[f"_raw_{c}" for c in seen])


def batched_cells(cells: DataFrame, start: int, stop: int, size: int, overlap: int = 0, idx: str = "cell_idx") -> DataFrame:
    """Cells of [start, stop) with every batch they are predicted in.

    A batch after the first starts ``overlap`` cells early, so a cell can be in several.
    """
    if size <= 0:
        raise ValueError("batch size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size and stop - start > size:
        raise ValueError("overlap must be smaller than the batch size")
    last = max((stop - start - 1) // size, 0)
    inside = cells.where((F.col(idx) >= start) & (F.col(idx) < stop))
    at = F.floor((F.col(idx) - start) / size)
    reach = F.least(F.floor((F.col(idx) - start + overlap) / size), F.lit(last))
    return inside.withColumn("batch_id", F.explode(F.sequence(at, F.greatest(at, reach))))


def merge_batches(predicted: DataFrame, outputs: list[str], idx: str = "cell_idx") -> DataFrame:
    """One value per cell: a later batch overwrites an earlier one."""
    return predicted.groupBy(KEY, idx).agg(*[F.max_by(o, "batch_id").alias(o) for o in outputs])


def predict_range(
    cells: DataFrame, predictor: Callable[[DataFrame], DataFrame], outputs: list[str],
    start: int, stop: int, size: int, overlap: int = 0,
) -> DataFrame:
    """Predict a range of cells in overlapping batches; ``predictor`` sees ``batch_id``."""
    return merge_batches(predictor(batched_cells(cells, start, stop, size, overlap)), outputs)


def check_range(rows: DataFrame, start: int, stop: int | None, idx: str = "cell_idx") -> int:
    """End of a tuning range of one experiment; a range outside its rows is an error."""
    n = rows.agg(F.coalesce(F.max(idx) + 1, F.lit(0)).alias("n")).first()["n"]
    if n == 0:
        raise ValueError("no rows to tune on")
    if start < 0 or start >= n:
        raise ValueError(f"start {start} is outside {n} rows")
    end = n if stop is None else stop
    if end <= start or end > n:
        raise ValueError(f"end {end} does not fit start {start} and {n} rows")
    return end


def fit_residual(rows: DataFrame, fitted: Fitted, start: int = 0, stop: int | None = None, idx: str = "cell_idx") -> dict[str, PipelineModel]:
    """A correction per output from rows [start, stop): error of the model on inputs and prediction."""
    end = check_range(rows, start, stop, idx)
    part = predict(rows.where((F.col(idx) >= start) & (F.col(idx) < end)), fitted, "base_")
    out = {}
    for o in fitted.outputs:
        names = [*fitted.inputs, f"base_{o}"]
        known = part.where(F.col(o).isNotNull()).withColumn("_label", F.col(o) - F.col(f"base_{o}"))
        stages = [
            VectorAssembler(inputCols=names, outputCol=f"_x_{o}", handleInvalid="skip"),
            LinearRegression(featuresCol=f"_x_{o}", labelCol="_label", predictionCol=f"_r_{o}", regParam=1e-6),
        ]
        out[o] = Pipeline(stages=stages).fit(known)
    return out


def predict_corrected(rows: DataFrame, fitted: Fitted, residual: dict[str, PipelineModel], prefix: str = "pred_") -> DataFrame:
    df = predict(rows, fitted, "base_")
    for o, model in residual.items():
        df = model.transform(df).withColumn(f"{prefix}{o}", F.col(f"base_{o}") + F.col(f"_r_{o}")).drop(f"_x_{o}", f"_r_{o}")
    return df.drop(*[f"base_{o}" for o in fitted.outputs])


def predict_performance(
    cells: DataFrame, fitted: Fitted, inputs: list[str], expr: Column, by: str = "cand_id", name: str = "perf"
) -> DataFrame:
    """Expected score per candidate: predict each cell, score it, average."""
    df = predict(cells, fitted)
    renamed = df.drop(*[o for o in fitted.outputs if o in df.columns]).withColumnsRenamed({f"pred_{o}": o for o in fitted.outputs})
    return score_candidates(renamed, inputs, expr, name, by)


def with_context(candidates: DataFrame, observed: DataFrame, name: str = "name", value: str = "value", ts: str = "ts", codes: list[str] = ()) -> DataFrame:
    """Put the latest observed covariates into every candidate."""
    latest = observed.agg(*[F.max_by(F.when(F.col(name) == c, F.col(value)), F.when(F.col(name) == c, F.col(ts))).alias(c) for c in codes])
    return candidates.withColumns({c: latest.select(c).scalar() for c in codes})


def save_bundle(fitted: Fitted, path: str, spark: SparkSession, sample: DataFrame | None = None) -> None:
    """Write models, scaling and vocabularies; with a sample, check that they read back the same."""
    if any(s.formula is not None for s in fitted.specs):
        raise ValueError("formula models are code; only fitted models can be bundled")
    for target, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/models/{target}")
    stats_table(spark, fitted.x_stats, fitted.y_stats).write.mode("overwrite").parquet(f"{path}/norm_stats")
    meta = {
        "specs": [{"name": s.name, "inputs": s.inputs, "outputs": s.outputs, "kind": s.kind, "options": s.options} for s in fitted.specs],
        "vocab": fitted.vocab,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if sample is not None:
        again = load_bundle(path, spark)
        names = [f"pred_{o}" for o in fitted.outputs]
        a, b = predict(sample, fitted).select(*names), predict(sample, again).select(*names)
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            raise RuntimeError("the bundle does not predict what the models do")


def load_bundle(path: str, spark: SparkSession) -> Fitted:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    specs = [ModelSpec(s["name"], tuple(s["inputs"]), tuple(s["outputs"]), s["kind"], None, s["options"]) for s in meta["specs"]]
    table = spark.read.parquet(f"{path}/norm_stats")
    models = {o: PipelineModel.load(f"{path}/models/{o}") for s in specs for o in s.outputs}
    return Fitted(specs, models, stats_from_table(table, "x"), stats_from_table(table, "y"), meta["vocab"])


def bundle_predict(rows: DataFrame, bundle: Fitted, keys: list[str] = (KEY,)) -> DataFrame:
    """Predict with a loaded bundle: unknown columns and labels are errors, missing columns are 0."""
    unknown = [c for c in rows.columns if c not in bundle.inputs and c not in keys]
    if unknown:
        raise ValueError(f"unknown parameter {', '.join(unknown)}; expected {', '.join(sorted(bundle.inputs))}")
    missing = [c for c in bundle.vocab if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(sorted(bundle.vocab[c])[0]) for c in missing})
    out = predict(rows, bundle, unknown="error")
    return out.select(*[k for k in keys if k in rows.columns], *[F.col(f"pred_{o}").alias(o) for o in bundle.outputs])
