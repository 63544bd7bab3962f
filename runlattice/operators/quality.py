"""Validation, coercion and completeness of experiment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY, num_rows
from runlattice.schema import Axis, Feature, Param


def rules(p: Param, v: Column) -> list[tuple[Column, str]]:
    """Conditions that a value of a parameter must not meet, with the names of the rules they break."""
    checks = []
    if p.required:
        checks.append((v.isNull(), "missing"))
    if p.kind == "int":
        checks.append((v.cast("double") != F.floor(v.cast("double")), "not_integer"))
    if p.kind == "category":
        checks.append((~v.isin(*p.vocab), "not_in_vocabulary"))
    if p.kind in ("real", "int"):
        if p.lo is not None:
            checks.append((v < p.lo, "below_min"))
        if p.hi is not None:
            checks.append((v > p.hi, "above_max"))
    return checks


def _rules(p: Param) -> list[Column]:
    v = F.col(p.name)
    return [
        F.when(bad, F.struct(F.lit(p.name).alias("param"), F.lit(rule).alias("rule"), v.cast("string").alias("found")))
        for bad, rule in rules(p, v)
    ]


def violations(df: DataFrame, params: list[Param]) -> DataFrame:
    """One row per broken rule; map-only."""
    found = F.array_compact(F.array(*[r for p in params for r in _rules(p)]))
    return df.select(KEY, F.explode(found).alias("v")).select(KEY, "v.param", "v.rule", "v.found")


def validated(df: DataFrame, params: list[Param]) -> DataFrame:
    """The same rows; the job fails at the first broken rule."""
    found = F.array_compact(F.array(*[r for p in params for r in _rules(p)]))
    message = F.concat(F.lit("invalid parameter: "), F.to_json(F.get(found, F.lit(0))))
    return df.where(F.when(F.size(found) > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def coerced(p: Param, v: Column | None = None) -> Column:
    """The value as its declared type: half-even integers, bools at 0.5, reals rounded."""
    v = F.col(p.name) if v is None else v
    if p.kind == "real":
        d = v.cast("double")
        return d if p.digits is None else F.bround(d, p.digits)
    if p.kind == "int":
        return F.bround(v.cast("double")).cast("long")
    if p.kind == "bool":
        return v.cast("double") >= 0.5
    return v.cast("string")


def sanitize(df: DataFrame, params: list[Param], ignore_unknown: bool = False, check: bool = True) -> DataFrame:
    """Coerce every parameter by its type, then validate.

    Columns that are no parameter are kept with ``ignore_unknown``, else they are an error.
    """
    known = {p.name for p in params} | {KEY}
    extra = [c for c in df.columns if c not in known]
    if extra and not ignore_unknown:
        raise KeyError(f"parameters not defined: {', '.join(extra)}")
    out = df.withColumns({p.name: coerced(p) for p in params if p.name in df.columns})
    return validated(out, [p for p in params if p.name in df.columns]) if check else out


def _cell(axes: list[Axis]) -> Column:
    """Flat index of a row's cell; NULL outside the experiment's own domain."""
    flat, inside = F.lit(0).cast("long"), F.lit(True)
    for k, a in enumerate(axes):
        flat = flat + F.col(a.index).cast("long") * num_rows(axes[k + 1 :])
        inside = inside & (F.col(a.index) >= 0) & (F.col(a.index) < F.col(a.size))
    return F.when(inside, flat)


def completeness(experiments: DataFrame, values: DataFrame, features: list[Feature], axes: list[Axis]) -> DataFrame:
    """(key, feature, expected, actual, nan, ok) for every experiment and declared feature.

    ``values`` is long: key, feature, value. Expected is the product of the experiment's own
    axis sizes up to the feature's depth. A feature without any row has nan 0, as it was
    never started; otherwise every cell without a value counts as nan. Where ``values`` has the
    axis indices, cells are counted: a repeated one once, one outside the domain not at all.

    The counts of an experiment are one row, a column per feature; it becomes a row per feature after it has met the sizes.
    """
    wanted = experiments.select(KEY, *[num_rows(axes[: f.depth]).alias(f"_e{i}") for i, f in enumerate(features)])
    declared = values.where(F.col("feature").isin(*[f.name for f in features]))
    has_value = F.col("value").isNotNull() & ~F.isnan("value")
    if all(a.index in values.columns for a in axes):
        cell = F.lit(None).cast("long")
        for f in features:
            cell = F.when(F.col("feature") == f.name, _cell(axes[: f.depth])).otherwise(cell)
        sized = experiments.select(KEY, *[a.size for a in axes])
        cells = declared.join(sized, KEY).groupBy(KEY, "feature", cell.alias("_cell")).agg(F.bool_or(has_value).alias("_has"))
        counted, has = cells, F.col("_has") & F.col("_cell").isNotNull()
    else:
        counted, has = declared, has_value
    there = counted.groupBy(KEY).agg(
        *[F.count_if((F.col("feature") == f.name) & has).alias(f"_n{i}") for i, f in enumerate(features)],
        *[F.bool_or(F.col("feature") == f.name).alias(f"_s{i}") for i, f in enumerate(features)],
    )
    zero = F.lit(0).cast("long")
    lines = []
    for i, f in enumerate(features):
        expected, actual = F.col(f"_e{i}"), F.coalesce(f"_n{i}", zero)
        missing = F.when(F.col(f"_s{i}"), expected - actual).otherwise(zero)
        named = {"feature": F.lit(f.name), "expected": expected, "actual": actual, "nan": missing, "ok": actual == expected}
        lines.append(F.struct(*[c.alias(n) for n, c in named.items()]))
    return wanted.join(there.hint("merge"), KEY, "left").select(KEY, F.inline(F.array(*lines)))


def incomplete(report: DataFrame) -> DataFrame:
    return report.where(~F.col("ok")).select(KEY, "feature")


def is_all_complete(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("complete"))


def complete_in_range(
    experiments: DataFrame, values: DataFrame, axes: list[Axis], value: str, start: int = 0, stop: int | None = None
) -> DataFrame:
    """Whether each experiment has a value at every flat cell of a range."""
    total = num_rows(axes)
    hi = total if stop is None else F.least(total, F.lit(stop).cast("long"))
    width = F.greatest(hi - F.lit(start), F.lit(0))
    idx = _cell(axes)
    sized = experiments.select(KEY, *[a.size for a in axes])
    inside = values.join(sized, KEY).where(
        (idx >= start) & (idx < hi) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    )
    counts = inside.select(KEY, idx.alias("_cell")).distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    return sized.join(counts, KEY, "left").select(KEY, (F.coalesce("_n", F.lit(0)) >= width).alias("complete"))


def populated(values: DataFrame, features: list[Feature]) -> DataFrame:
    """Experiments with at least one stored row of every declared feature."""
    names = [f.name for f in features]
    return (
        values.where(F.col("feature").isin(*names))
        .groupBy(KEY)
        .agg(*[F.bool_or(F.col("feature") == n).alias(f"_s{i}") for i, n in enumerate(names)])
        .where(reduce(lambda a, b: a & b, [F.col(f"_s{i}") for i in range(len(names))], F.lit(True)))
        .select(KEY)
    )


def state_report(experiments: DataFrame, scores: DataFrame, populated_keys: DataFrame, params: list[str]) -> DataFrame:
    """Counts of experiments: all, with parameters, with scores, with every feature."""
    has_params = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in params])
    with_scores = scores.select(KEY).distinct().withColumn("_s", F.lit(True))
    with_features = populated_keys.select(KEY).distinct().withColumn("_f", F.lit(True))
    return (
        experiments.join(with_scores, KEY, "left")
        .join(with_features, KEY, "left")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(has_params).alias("parameters"),
            F.count_if(F.col("_f")).alias("features"),
            F.count_if(F.col("_s")).alias("performance"),
        )
    )


