"""Space-filling designs and candidate generation."""

from __future__ import annotations

import hashlib
from functools import reduce
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.schema import Param

BITS = 30
# Primitive polynomials (degree, coefficients) and initial direction numbers of
# dimensions 2 … 21, from the public Joe–Kuo table.
JOE_KUO = [
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
    (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)),
    (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)),
    (7, 4, (1, 3, 7, 13, 13, 15, 69)),
]
MAX_DIMS = len(JOE_KUO) + 1


def direction_numbers(dim: int) -> list[int]:
    """BITS direction numbers of one dimension (0-based), scaled to BITS bits."""
    if dim == 0:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    if dim >= MAX_DIMS:
        raise ValueError(f"at most {MAX_DIMS} dimensions")
    s, a, start = JOE_KUO[dim - 1]
    v = [m << (BITS - 1 - i) for i, m in enumerate(start)]
    for i in range(s, BITS):
        x = v[i - s] ^ (v[i - s] >> s)
        for k in range(1, s):
            if (a >> (s - 1 - k)) & 1:
                x ^= v[i - k]
        v.append(x)
    return v


def digital_shift(dim: int, seed: int) -> int:
    """Random bits of one dimension; the same on every executor."""
    return int(hashlib.md5(f"{seed}/{dim}".encode()).hexdigest(), 16) % (1 << BITS)


def sobol_points(index: np.ndarray, dims: int, seed: int = 0) -> np.ndarray:
    """Points (n, dims) of a digitally shifted Sobol sequence at the given indices."""
    index = np.asarray(index, dtype=np.int64)
    gray = index ^ (index >> 1)
    out = np.empty((len(index), dims))
    for d in range(dims):
        x = np.full(len(index), digital_shift(d, seed), dtype=np.int64)
        for b, v in enumerate(direction_numbers(d)):
            x ^= ((gray >> b) & 1) * v
        out[:, d] = (x + 0.5) / (1 << BITS)
    return out


def sobol(index: Column, dim: int, seed: int = 0) -> Column:
    """One coordinate of the same sequence as a column; point i depends on i alone."""
    i = index.cast("long")
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    terms = [
        F.when(F.getbit(gray, F.lit(b)) == 1, F.lit(v).cast("long")).otherwise(F.lit(0).cast("long"))
        for b, v in enumerate(direction_numbers(dim))
    ]
    x = reduce(lambda a, t: a.bitwiseXOR(t), terms, F.lit(digital_shift(dim, seed)).cast("long"))
    return (x.cast("double") + 0.5) / float(1 << BITS)


def unit_points(df: DataFrame, index: str, names: list[str], seed: int = 0) -> DataFrame:
    """Add low-discrepancy coordinates to rows numbered 0, 1, 2, …"""
    return df.withColumns({n: sobol(F.col(index), d, seed) for d, n in enumerate(names)})


def to_real(u: Column, p: Param) -> Column:
    """Unit coordinate to a value in the parameter's range; integers are rounded and clipped."""
    span = p.hi - p.lo
    if p.kind == "int":
        return F.greatest(F.lit(p.lo), F.least(F.lit(p.hi), F.bround(u * span) + p.lo)).cast("long")
    return u * span + p.lo


def count_strata(categories: list[Param]) -> int:
    """Number of label combinations."""
    return prod(len(p.vocab) for p in categories)


def labels_of(stratum: Column, categories: list[Param]) -> dict[str, Column]:
    """The labels of a numbered combination, the last category varying fastest: the number's digits in the sizes of the vocabularies."""
    out, inner = {}, 1
    for p in reversed(categories):
        digit = F.floor(stratum / inner) % len(p.vocab)
        out[p.name] = F.get(F.lit(list(p.vocab)), digit.cast("int"))
        inner *= len(p.vocab)
    return {p.name: out[p.name] for p in categories}


def strata(spark: SparkSession, categories: list[Param]) -> DataFrame:
    """Every combination of the categories' labels, a row each, numbered in ``stratum``."""
    return spark.range(count_strata(categories)).select(F.col("id").alias("stratum"), *[c.alias(n) for n, c in labels_of(F.col("id"), categories).items()])


def assign_strata(df: DataFrame, index: str, n: Column | int, categories: list[Param]) -> DataFrame:
    """Split n numbered rows evenly over all label combinations, the rest to the first ones."""
    k = count_strata(categories)
    total = F.lit(n) if isinstance(n, int) else n
    each = F.floor(total / k)
    extra = total % k
    edge = extra * (each + 1)
    spot = F.when(F.col(index) < edge, F.floor(F.col(index) / (each + 1))).otherwise(
        extra + F.floor((F.col(index) - edge) / F.greatest(each, F.lit(1)))
    )
    placed = df.withColumn("stratum", spot.cast("long"))
    return placed.withColumns(labels_of(F.col("stratum"), categories))


def fill_defaults(
    df: DataFrame, params: list[Param], fixed: dict | None = None, means: dict | None = None
) -> DataFrame:
    """Columns that are not varied: the fixed value, else what the row has (its stratum), else
    the middle of the range, else the training mean."""
    fixed, means = fixed or {}, means or {}
    new = {}
    for p in params:
        choices = []
        if p.name in fixed:
            choices.append(F.lit(fixed[p.name]))
        if p.name in df.columns:
            choices.append(F.col(p.name))
        if p.lo is not None and p.hi is not None:
            choices.append(to_real(F.lit(0.5), p))
        elif p.name in means:
            choices.append(F.lit(means[p.name]))
        if not choices:
            raise ValueError(f"no value for {p.name!r}")
        new[p.name] = F.coalesce(*choices)
    return df.withColumns(new)


def derive(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Derived parameters, computed where they are absent."""
    return df.withColumns({c: F.coalesce(F.col(c), e) if c in df.columns else e for c, e in derived.items()})


def sobol_design(
    df: DataFrame,
    index: str,
    params: list[Param],
    n: Column | int,
    fixed: dict | None = None,
    derived: dict[str, Column] | None = None,
    seed: int = 0,
    trajectories: bool = False,
) -> DataFrame:
    """A space-filling design over numbered rows: one experiment per row, with its snapshot."""
    if trajectories:
        raise ValueError("a space-filling design has no trajectories")
    fixed = fixed or {}
    free = [p for p in params if p.name not in fixed]
    numeric = [p for p in free if p.kind in ("real", "int")]
    categories = [p for p in free if p.kind == "category"]
    out = unit_points(df.select(index), index, [f"_u{d}" for d in range(len(numeric))], seed)
    if categories:
        out = assign_strata(out, index, n, categories)
    out = out.withColumns({p.name: to_real(F.col(f"_u{d}"), p) for d, p in enumerate(numeric)})
    out = out.withColumns({c: F.lit(v) for c, v in fixed.items()})
    out = derive(out, derived or {})
    out = out.withColumns({p.name: F.bround(p.name, p.digits) for p in numeric if p.kind == "real" and p.digits is not None})
    snap = snapshot("sobol_step", seed=seed, design="sobol")
    return out.select(index, *[p.name for p in params], *(derived or {}), snap.alias("config_snapshot"))


def number_range(spark: SparkSession, n: int, name: str = "cand_id") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def snapshot(source: str, **settings) -> Column:
    """JSON record of how a proposal was made."""
    return F.to_json(F.struct(F.lit(source).alias("source"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in settings.items()]))


def global_bounds(params: list[Param], configured: dict | None = None, fixed: dict | None = None) -> dict[str, tuple[float, float]]:
    """Ranges to search: fixed values first, then configured, then declared ones.

    Categories span their indices. Configured ends outside the declared ones are an error.
    """
    configured, fixed = configured or {}, fixed or {}
    out = {}
    for p in params:
        if p.kind == "category":
            if p.name in fixed:
                at = float(sorted(p.vocab).index(fixed[p.name]))
                out[p.name] = (at, at)
            else:
                out[p.name] = (0.0, float(len(p.vocab) - 1))
        elif p.name in fixed:
            out[p.name] = (float(fixed[p.name]), float(fixed[p.name]))
        elif p.name in configured:
            lo, hi = configured[p.name]
            if (p.lo is not None and lo < p.lo) or (p.hi is not None and hi > p.hi):
                raise ValueError(f"bounds of {p.name!r} leave the declared range")
            out[p.name] = (float(lo), float(hi))
        elif p.lo is not None and p.hi is not None:
            out[p.name] = (float(p.lo), float(p.hi))
        else:
            raise ValueError(f"no bounds for {p.name!r}")
    return out


def trust_region(current: DataFrame, deltas: dict[str, float], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per row, the range around its current values that stays within the global one.

    A parameter without a delta keeps its value.
    """
    new = {}
    for c, (lo, hi) in limits.items():
        d = deltas.get(c, 0.0)
        new[f"{c}_lo"] = F.greatest(F.lit(lo), F.col(c) - d)
        new[f"{c}_hi"] = F.least(F.lit(hi), F.col(c) + d)
    return current.withColumns(new)


def tunable(params: list[Param], fixed: dict | None = None, context: list[str] = ()) -> list[str]:
    """Parameters a step may change."""
    return [p.name for p in params if p.name not in (fixed or {}) and p.name not in context]


def sweep(
    df: DataFrame,
    x: tuple[str, Column | float, Column | float, int],
    y: tuple[str, Column | float, Column | float, int],
    fixed: dict | None = None,
    derived: dict[str, Column] | None = None,
) -> DataFrame:
    """An evenly spaced grid over two parameters for each row; other columns stay as they are."""

    def line(spec, i):
        _, lo, hi, n = spec
        lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
        return lo + (hi - lo) * i / float(max(n - 1, 1))

    (xn, *_, nx), (yn, *_, ny) = x, y
    flat = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    flat = flat.withColumns({"ix": F.floor(F.col("_i") / ny).cast("int"), "iy": (F.col("_i") % ny).cast("int")})
    flat = flat.withColumns({xn: line(x, F.col("ix")), yn: line(y, F.col("iy"))}).drop("_i")
    flat = flat.withColumns({c: F.lit(v) for c, v in (fixed or {}).items()})
    return derive(flat, derived or {})


def sigmoid(v: Column, k: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-k * v))


def trajectory_layers(
    candidates: DataFrame, layers: Column, specs: dict[str, tuple[Column, Column]], slope_max: float = 0.8
) -> DataFrame:
    """One row per candidate and layer from a midpoint and a slope per parameter.

    Values are in the unit range; the slope is squeezed into ±slope_max. Each of L layers
    weighs 1/L; layers 1 … L-1 are the update events.
    """
    n = F.greatest(layers.cast("int"), F.lit(1))
    df = candidates.withColumn("n_steps", n).withColumn("step", F.explode(F.sequence(F.lit(0), n - 1)))
    off = F.col("step") - F.floor(F.col("n_steps") / 2)
    new = {}
    for c, (mid, slope) in specs.items():
        bounded = sigmoid(slope) * 2.0 * slope_max - slope_max
        new[c] = sigmoid(mid + off * bounded)
    return df.withColumns({**new, "weight": 1.0 / F.col("n_steps"), "is_event": F.col("step") > 0})
