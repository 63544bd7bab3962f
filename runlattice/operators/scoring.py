"""Performance scores in [0, 1] from features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY

# Columns whose values the schema declares: a table grouped by them alone is known to be small.
DECLARED = ("perf_code", "feature", "model")


def small_if_declared(df: DataFrame, by: list[str]) -> DataFrame:
    """Broadcast a per-group table only where the schema bounds the number of groups."""
    return F.broadcast(df) if set(by) <= set(DECLARED) else df


def clipped(expr: Column) -> Column:
    """A score cut to [0, 1]; NULL and NaN stay missing."""
    d = expr.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def score_rows(cells: DataFrame, inputs: list[str], expr: Column, name: str = "score") -> DataFrame:
    """Score each cell; a cell that lacks an input has none."""
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in inputs])
    return cells.withColumn(name, F.when(there, clipped(expr)))


def score_experiments(scored: DataFrame, name: str = "score", by: list[str] = (KEY,)) -> DataFrame:
    """Mean of the cells that have a score; NULL where none has."""
    return scored.groupBy(*by).agg(F.avg(name).alias(name))


def aggregate_then_score(
    cells: DataFrame, inputs: list[str], how: str, expr: Column, name: str = "score", by: list[str] = (KEY,)
) -> DataFrame:
    """Sum or mean each input over the cells that have it, then score once."""
    if how not in ("sum", "mean"):
        raise ValueError("aggregate by sum or mean")
    f = F.sum if how == "sum" else F.avg
    reduced = cells.groupBy(*by).agg(*[f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in inputs])
    return score_rows(reduced, inputs, expr, name).select(*by, name)


def score_candidates(
    cells: DataFrame, inputs: list[str], expr: Column, name: str = "score", by: str = "cand_id", missing: str = "zero"
) -> DataFrame:
    """Mean score per candidate; one with a missing cell is 0, or NULL with ``missing="null"``."""
    scored = score_rows(cells, inputs, expr, name)
    whole = F.count(name) == F.count(F.lit(1))
    mean = F.when(whole, F.avg(name))
    return scored.groupBy(by).agg((F.coalesce(mean, F.lit(0.0)) if missing == "zero" else mean).alias(name))


def evaluate(
    cells: DataFrame,
    scorers: dict[str, tuple[list[str], Column]],
    stored: DataFrame | None = None,
    recompute: bool = False,
    feature: str | None = None,
) -> DataFrame:
    """(key, perf_code, score) of all scorers in one pass, next to what is stored.

    A score that exists is kept unless ``recompute``; a scorer is skipped for an experiment
    where one of its inputs has no value at all, and altogether when none of its inputs
    matches the ``feature`` substring.
    """
    used = {
        p: s for p, s in scorers.items() if feature is None or any(feature.lower() in i.lower() for i in s[0])
    }
    for p, (inputs, expr) in used.items():
        cells = score_rows(cells, inputs, expr, f"_s_{p}")
    inputs = sorted({i for ins, _ in used.values() for i in ins})
    if not used:
        return stored
    wide = cells.groupBy(KEY).agg(
        *[F.avg(f"_s_{p}").alias(f"_s_{p}") for p in used],
        *[F.count(F.when(~F.isnan(F.col(i).cast("double")), F.col(i))).alias(f"_n_{i}") for i in inputs],
    )
    pieces = [
        F.when(
            reduce(lambda a, b: a & b, [F.col(f"_n_{i}") > 0 for i in used[p][0]]),
            F.struct(F.lit(p).alias("perf_code"), F.col(f"_s_{p}").alias("score")),
        )
        for p in used
    ]
    new = wide.select(KEY, F.explode(F.array_compact(F.array(*pieces))).alias("r")).select(KEY, "r.perf_code", "r.score")
    if stored is None:
        return new
    held = stored.where("score IS NOT NULL").select(KEY, "perf_code")
    if recompute:
        return stored.join(new.select(KEY, "perf_code"), [KEY, "perf_code"], "left_anti").unionByName(new)
    fresh = new.join(held, [KEY, "perf_code"], "left_anti")
    kept = stored.join(fresh.select(KEY, "perf_code"), [KEY, "perf_code"], "left_anti")
    return kept.unionByName(fresh)


def combined_score(scores: DataFrame, weights: dict[str, float], by: list[str] = (KEY,), name: str = "combined") -> DataFrame:
    """Weighted mean over the weighted scores that are present; 0 without any weight."""
    w = reduce(lambda acc, i: acc.when(F.col("perf_code") == i[0], float(i[1])), weights.items(), F.when(F.lit(False), 0.0))
    used = F.when(F.col("score").isNotNull(), w)
    total = F.coalesce(F.sum(used), F.lit(0.0))
    value = F.sum(used * F.col("score"))
    return scores.groupBy(*by).agg(F.when(total > 0, value / total).otherwise(F.lit(0.0)).alias(name))


def normalized_scores(scores: DataFrame, by: str = "perf_code", value: str = "score", name: str = "normalized") -> DataFrame:
    """(p - min) / (max - min) per score, 0.5 where all are the same."""
    ends = scores.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (
        scores.join(small_if_declared(ends, [by]), by)
        .withColumn(name, F.when(span > 1e-10, (F.col(value) - F.col("_lo")) / span).otherwise(F.lit(0.5)))
        .drop("_lo", "_hi")
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean, spread and ends of each score."""
    return scores.groupBy("perf_code").agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("lowest"),
        F.max("score").alias("highest"),
        F.count("score").alias("n"),
    )
