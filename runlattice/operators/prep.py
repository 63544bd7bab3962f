"""Model inputs: statistics from training rows, scaling, codes, lags, batches."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlattice.functions.blocked import lag_dense, positions
from runlattice.functions.quantiles import exact_quantiles
from runlattice.operators.asof import params_at_last_row
from runlattice.operators.grid import KEY, expand_domain, with_positions
from runlattice.schema import Axis, Param

METHODS = ("none", "standard", "min_max", "robust")
# The forward transform is damped, the reverse one is not.
EPSILON = 1e-8
FLAT = 1e-12
STATS_SCHEMA = (
    "side string, column string, method string, mean double, std double, min double, max double, "
    "median double, q1 double, q3 double"
)


@dataclass(frozen=True)
class Stats:
    """Scaling of one column."""

    column: str
    method: str
    side: str = "x"
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    median: float | None = None
    q1: float | None = None
    q3: float | None = None

    def forward(self, v: Column) -> Column:
        if self.method == "standard":
            return (v - self.mean) / (self.std + EPSILON)
        if self.method == "min_max":
            span = self.max - self.min
            return v * 0.0 if span < FLAT else (v - self.min) / (span + EPSILON)
        if self.method == "robust":
            return (v - self.median) / (self.q3 - self.q1 + EPSILON)
        return v

    def reverse(self, v: Column) -> Column:
        if self.method == "standard":
            return v * self.std + self.mean
        if self.method == "min_max":
            span = self.max - self.min
            return v * 0.0 + self.min if span < FLAT else v * span + self.min
        if self.method == "robust":
            return v * (self.q3 - self.q1) + self.median
        return v

    @property
    def center(self) -> float | None:
        """Mean of a column where it is known, else its middle."""
        if self.mean is not None:
            return self.mean
        return None if self.min is None else (self.min + self.max) / 2


def fit_norm(train: DataFrame, methods: dict[str, str], side: str = "x", lagged: dict[str, str] = ()) -> dict[str, Stats]:
    """Scaling of each column from training rows only, in one pass over them.

    NULL and NaN are ignored; a column without values is left out. Robust columns take a few
    more passes for exact quartiles and the lower median. ``lagged`` maps a lagged column to
    its base, whose scaling it reuses. The result is one small record per column.
    """
    for m in methods.values():
        if m not in METHODS:
            raise ValueError(f"unknown method {m!r}")
    cols = [c for c, m in methods.items() if m != "none"]
    if "robust" not in methods.values() or train.is_cached:
        return _fit(train, methods, cols, side, dict(lagged))
    # Quartiles take a few passes; the columns are kept (with their lineage) in between.
    train = train.select(*cols).persist()
    try:
        return _fit(train, methods, cols, side, dict(lagged))
    finally:
        train.unpersist()


def _fit(train: DataFrame, methods: dict[str, str], cols: list[str], side: str, lagged: dict[str, str]) -> dict[str, Stats]:
    out: dict[str, Stats] = {}
    if cols:
        robust = [c for c in cols if methods[c] == "robust"]
        plain = [c for c in cols if c not in robust]
        if plain:
            def val(c):
                return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

            row = train.agg(
                *[
                    f(val(c)).alias(f"{c}\u0001{k}")
                    for c in plain
                    for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
                ]
            ).first()
            for c in plain:
                if row[f"{c}\u0001mean"] is not None:
                    out[c] = Stats(c, methods[c], side, *[row[f"{c}\u0001{k}"] for k in ("mean", "std", "min", "max")])
        if robust:
            for c, q in exact_quantiles(train, robust, [0.25, 0.75], [0.5]).items():
                if q is not None:
                    out[c] = Stats(
                        c, "robust", side, min=q["min"], max=q["max"], median=q[("low", 0.5)], q1=q[("q", 0.25)], q3=q[("q", 0.75)]
                    )
    for c, base in lagged.items():
        if base in out:
            out[c] = Stats(**{**asdict(out[base]), "column": c})
    return out


def stats_table(spark: SparkSession, *groups: dict[str, Stats]) -> DataFrame:
    rows = [tuple(getattr(s, f.split()[0]) for f in STATS_SCHEMA.split(", ")) for g in groups for s in g.values()]
    return spark.createDataFrame(rows, STATS_SCHEMA)


def stats_from_table(df: DataFrame, side: str = "x") -> dict[str, Stats]:
    """Read a small statistics table back; one row per column."""
    return {r["column"]: Stats(**r.asDict()) for r in df.where(F.col("side") == side).collect()}


def apply_norm(df: DataFrame, stats: dict[str, Stats]) -> DataFrame:
    return df.withColumns({c: s.forward(F.col(c)) for c, s in stats.items() if c in df.columns})


def reverse_norm(df: DataFrame, stats: dict[str, Stats]) -> DataFrame:
    return df.withColumns({c: s.reverse(F.col(c)) for c, s in stats.items() if c in df.columns})


def normalize_bounds(stats: dict[str, Stats], column: str, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Ends of a range after scaling, in order; unchanged without statistics."""
    if column not in stats:
        return lo, hi
    a, b = stats[column].forward(lo), stats[column].forward(hi)
    return F.least(a, b), F.greatest(a, b)


def category_index(col: Column, vocab: list[str], unknown: str = "zero") -> Column:
    """0-based place in the sorted vocabulary; unknown labels are 0 or an error."""
    found = F.array_position(F.lit(sorted(vocab)), col) - 1
    if unknown == "error":
        return F.when(found >= 0, found).otherwise(
            F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(col, F.lit("NULL")))).cast("bigint")
        )
    return F.coalesce(F.when(found >= 0, found), F.lit(0).cast("bigint"))


def category_label(idx: Column, vocab: list[str]) -> Column:
    """Label at a rounded index, clamped to the vocabulary."""
    labels = sorted(vocab)
    at = F.greatest(F.lit(0), F.least(F.bround(idx.cast("double")), F.lit(len(labels) - 1))).cast("int")
    return F.get(F.lit(labels), at)


def decode(df: DataFrame, params: list[Param], stats: dict[str, Stats], context: list[str] = ()) -> DataFrame:
    """Scaled columns back to parameter values; observed (context) inputs are left out."""
    out = reverse_norm(df, {c: s for c, s in stats.items() if c not in context})
    new = {}
    for p in params:
        if p.name in context:
            continue
        if p.kind == "category":
            new[p.name] = category_label(F.col(p.name), list(p.vocab))
        elif p.kind == "int":
            new[p.name] = F.bround(F.col(p.name)).cast("long")
        elif p.kind == "bool":
            new[p.name] = F.col(p.name) >= 0.5
        elif p.digits is not None:
            new[p.name] = F.bround(F.col(p.name), p.digits)
    return out.withColumns(new).drop(*context)


def add_lags(rows: DataFrame, columns: list[str], k: int = 1, idx: str = "cell_idx") -> DataFrame:
    """``prev_<c>``: the value k rows earlier in the experiment, its own in the first k."""
    lagged = lag_dense(rows, [KEY], idx, {f"prev_{c}": c for c in columns}, k)
    return lagged.withColumns(
        {f"prev_{c}": F.when(F.col(idx) >= k, F.col(f"prev_{c}")).otherwise(F.col(c)) for c in columns}
    )


def inject_context(rows: DataFrame, context: list[str], outputs: list[str]) -> tuple[DataFrame, list[str]]:
    """Copy observed values to the inputs as ``ctx_<c>``; they are no outputs."""
    return rows.withColumns({f"ctx_{c}": F.col(c) for c in context}), [c for c in outputs if c not in context]


def exclude_rows(rows: DataFrame, excluded: dict[str, list[int]]) -> DataFrame:
    """Drop the listed index values of each axis; to be called before statistics are fitted."""
    for axis, values in excluded.items():
        rows = rows.where(~F.col(axis).isin(*values))
    return rows


def drop_missing_targets(rows: DataFrame, outputs: list[str]) -> tuple[DataFrame, Observation]:
    """Rows with every target; the observation holds ``n_rows`` and ``n_dropped`` after an action."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in outputs])
    seen = Observation()
    marked = rows.withColumn("_bad", bad).observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_bad")).alias("n_dropped")
    )
    return marked.where(~F.col("_bad")).drop("_bad"), seen


def fill_inputs(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """Missing numbers are 0 before scaling; a missing column is 0 throughout."""
    return rows.withColumns(
        {
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
            for c in inputs
        }
    )


def batches(rows: DataFrame, size: int, seq: str = "exp_seq", idx: str = "cell_idx") -> DataFrame:
    """Ordered batches of rows: ``batch_id`` and the place of the row over all."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    placed = positions(rows, [seq, idx], name="row_pos")
    return placed.withColumn("batch_id", F.floor(F.col("row_pos") / size))


def calibration_arrays(
    experiments: DataFrame, updates: DataFrame, scores: DataFrame, axes: list[Axis], params: list[str],
    perf_order: list[str], strict: bool = True,
) -> DataFrame:
    """One row per experiment: parameters at its last cell, then its scores.

    An experiment without one of the scores is an error when strict, else it is left out.
    """
    if not perf_order:
        raise ValueError("perf_order must name at least one score")
    wide = scores.where(F.col("perf_code").isin(*perf_order)).groupBy(KEY).pivot("perf_code", perf_order).agg(F.max("score"))
    last = params_at_last_row(experiments, updates, axes, params).select(KEY, *params)
    joined = last.join(wide, KEY, "left")
    whole = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in perf_order])
    if strict:
        return joined.where(
            F.when(whole, True).otherwise(
                F.raise_error(F.concat(F.lit("missing scores of experiment "), F.col(KEY).cast("string"))).cast("boolean")
            )
        )
    return joined.where(whole)


def flat_batch(candidates: DataFrame, axes: list[Axis], stats: dict[str, Stats]) -> DataFrame:
    """One scaled row per candidate and cell; positions come from the cell, not the candidate."""
    return apply_norm(with_positions(expand_domain(candidates, axes), axes), stats)


def sequence_batch(
    cells: DataFrame, by: list[str], axis: Axis, inputs: list[str], targets: list[str] = (), max_length: int | None = None
) -> DataFrame:
    """One row per sequence along an axis, steps in order, padded to one length.

    ``steps`` holds a struct of inputs and targets per step, ``mask`` is 1 where a step is real
    and all its targets are known. The length is the axis' declared maximum unless given.
    """
    length = max_length or axis.max_size
    body = F.struct(F.col(axis.index).alias("pos"), *[F.col(c).cast("double").alias(c) for c in [*inputs, *targets]])
    grouped = cells.groupBy(*by).agg(F.array_sort(F.collect_list(body)).alias("steps"))
    known = F.transform(
        "steps",
        lambda s: reduce(lambda a, b: a & b, [s[t].isNotNull() for t in targets], F.lit(True)).cast("int"),
    )
    n = F.size("steps")
    pad = F.struct(
        F.lit(-1).alias("pos"),
        *[F.lit(0.0).alias(c) for c in inputs],
        *[F.lit(None).cast("double").alias(c) for c in targets],
    )
    missing = F.greatest(F.lit(length) - n, F.lit(0))
    return grouped.select(
        *by,
        n.alias("length"),
        F.concat("steps", F.array_repeat(pad, missing)).alias("steps"),
        F.concat(known, F.array_repeat(F.lit(0), missing)).alias("mask"),
    )


def to_unit(value: Column, lo: Column, hi: Column) -> Column:
    """Points: (z - lo) / span, an empty span counts as 1."""
    span = hi - lo
    return (value - lo) / F.when(span > 1e-10, span).otherwise(F.lit(1.0))


def value_to_unit(value: Column, lo: Column, hi: Column) -> Column:
    """Values: (v - lo) / span, 0.5 on an empty span."""
    span = hi - lo
    return F.when(span > 0, (value - lo) / span).otherwise(F.lit(0.5))


