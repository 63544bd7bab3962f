"""Cells of an experiment's domain: expansion, positions, dense and sparse forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.functions.blocked import BLOCK
from runlattice.schema import Axis, Feature, find_axis
from runlattice.session import spread

KEY = "exp_code"
# Cells per experiment from which on an expansion is spread over all tasks first.
WIDE = 64


def num_rows(axes: list[Axis]) -> Column:
    """Cells of an experiment: product of its axis sizes, 1 without axes."""
    return reduce(lambda a, b: a * b, [F.col(x.size).cast("long") for x in axes], F.lit(1).cast("long"))


def stride(axes: list[Axis], name: str) -> Column:
    """Row-major step of the axis named by its size column or its index column."""
    return num_rows(axes[find_axis(axes, name) + 1 :])


def step_bounds(axes: list[Axis], name: str, step: Column) -> tuple[Column, Column]:
    """Flat cell range [from, to) that one step of an axis covers."""
    s = stride(axes, name)
    return step * s, (step + 1) * s


def position(axis: Axis) -> Column:
    """Implicit input: index scaled to [0, 1]; 0 on an axis of one cell."""
    return F.col(axis.index) / F.greatest(F.col(axis.size) - 1, F.lit(1))


def cell_index(axes: list[Axis]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.col(x.index).cast("long") * stride(axes, x.index) for x in axes],
        F.lit(0).cast("long"),
    )


def expand_domain(
    experiments: DataFrame,
    axes: list[Axis],
    depth: int | None = None,
    start: int = 0,
    stop: int | None = None,
) -> DataFrame:
    """One row per cell, in row-major order, optionally a flat slice of it.

    Experiments are spread over all tasks before they grow. Cells come from the flat index, so
    a big experiment is first cut into blocks that go to different tasks; the plan only does so
    where the declared axis bounds allow such sizes.
    """
    used = axes if depth is None else axes[:depth]
    total = num_rows(used)
    last = total if stop is None else F.least(total, F.lit(stop).cast("long"))
    bound = reduce(lambda a, b: a * b, [a.max_size for a in used], 1)
    lo, hi = F.lit(start).cast("long"), last
    df = experiments
    if bound > BLOCK:
        cut = F.when(hi > lo, F.sequence(F.floor(lo / BLOCK), F.floor((hi - 1) / BLOCK))).otherwise(
            F.array().cast("array<bigint>")
        )
        df = spread(df.withColumn("_blk", F.explode(cut)), KEY, "_blk")
        lo = F.greatest(lo, F.col("_blk") * BLOCK)
        hi = F.least(hi, (F.col("_blk") + 1) * BLOCK)
    elif bound > WIDE:
        df = spread(df, KEY)
    flat = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("cell_idx", F.explode(flat))
    index = [
        (F.floor(F.col("cell_idx") / stride(used, a.index)) % F.col(a.size)).cast("int").alias(a.index)
        for a in used
    ]
    return df.select("*", *index).drop("_blk")


def with_positions(cells: DataFrame, axes: list[Axis]) -> DataFrame:
    return cells.withColumns({f"{a.index}_pos": position(a) for a in axes})


def slice_at(cells: DataFrame, axis: str, value: int) -> DataFrame:
    return cells.where(F.col(axis) == value)


def step_range(cells: DataFrame, axes: list[Axis], name: str, step: int) -> DataFrame:
    """Cells that belong to one step of an axis, by flat index."""
    lo, hi = step_bounds(axes, name, F.lit(step))
    return cells.where((F.col("cell_idx") >= lo) & (F.col("cell_idx") < hi))


def out_of_bounds(rows: DataFrame, experiments: DataFrame, axes: list[Axis]) -> DataFrame:
    """Sparse rows whose index lies outside their experiment's own sizes."""
    sizes = experiments.select(KEY, *[a.size for a in axes])
    bad = reduce(
        lambda a, b: a | b,
        [(F.col(a.index) < 0) | (F.col(a.index) >= F.col(a.size)) for a in axes],
        F.lit(False),
    )
    return rows.join(sizes, KEY).where(bad)


def fill_grid(
    rows: DataFrame, experiments: DataFrame, axes: list[Axis], value: str, seq: str | None = None
) -> DataFrame:
    """Every cell of every experiment with its value, NULL where nothing was measured.

    With ``seq`` the row with the greatest seq wins among repeats of a cell.
    """
    names = [a.index for a in axes]
    if seq is None:
        unique = rows.select(KEY, *names, value)
    else:
        unique = rows.groupBy(KEY, *names).agg(F.max_by(value, seq).alias(value))
    full = expand_domain(experiments.select(KEY, *[a.size for a in axes]), axes)
    return full.join(unique, [KEY, *names], "left")


def to_dense(filled: DataFrame, axes: list[Axis], value: str, chunk: int = BLOCK) -> DataFrame:
    """Dense row-major arrays, cut into chunks of bounded length."""
    part = F.floor(F.col("cell_idx") / chunk)
    return (
        filled.withColumn("chunk", part)
        .groupBy(KEY, "chunk", F.array(*[F.col(a.size) for a in axes]).alias("shape"))
        .agg(F.array_sort(F.collect_list(F.struct("cell_idx", F.col(value).alias("v")))).alias("_c"))
        .select(KEY, "chunk", "shape", F.col("_c.v").alias("values"))
    )


def to_sparse(dense: DataFrame, axes: list[Axis], value: str, chunk: int = BLOCK) -> DataFrame:
    """Rows (key, cell index, axis indices, value) of dense chunks."""
    rows = dense.select(KEY, "chunk", "shape", F.posexplode("values").alias("_o", value))
    rows = rows.withColumn("cell_idx", F.col("chunk") * chunk + F.col("_o"))
    out = []
    for pos, axis in enumerate(axes):
        inner = reduce(
            lambda a, b: a * b,
            [F.get("shape", F.lit(p)).cast("long") for p in range(pos + 1, len(axes))],
            F.lit(1).cast("long"),
        )
        out.append(
            (F.floor(F.col("cell_idx") / inner) % F.get("shape", F.lit(pos))).cast("int").alias(axis.index)
        )
    return rows.select(KEY, "cell_idx", *out, value)


def value_at(cells: DataFrame, values: DataFrame, feature: Feature, axes: list[Axis], deeper: str = "null"):
    """Add a feature's value at each cell.

    A shallower feature repeats over the deeper axes; one with an axis the cells lack is NULL
    (``deeper="null"``) or averaged over that axis (``deeper="mean"``).
    """
    need = [a.index for a in axes[: feature.depth]]
    have = [n for n in need if n in cells.columns]
    source = values.select(KEY, *need, F.col(feature.name))
    if have != need:
        if deeper == "null":
            return cells.withColumn(feature.name, F.lit(None).cast("double"))
        source = source.groupBy(KEY, *have).agg(F.avg(feature.name).alias(feature.name))
    return cells.join(source, [KEY, *have], "left")


def init_grid(
    experiments: DataFrame, axes: list[Axis], value: str, existing: DataFrame | None = None, recompute: bool = False
) -> DataFrame:
    """NULL in every cell, or the values that exist unless they are to be recomputed."""
    if existing is None or recompute:
        full = expand_domain(experiments.select(KEY, *[a.size for a in axes]), axes)
        return full.withColumn(value, F.lit(None).cast("double"))
    return fill_grid(existing, experiments, axes, value)


def layer_points(points: DataFrame, by: str = KEY) -> DataFrame:
    """Weight 1/L on each of an experiment's L points."""
    layers = points.groupBy(by).agg(F.count(F.lit(1)).alias("n_points"))
    return points.join(layers, by).withColumn("weight", 1.0 / F.col("n_points"))


def layer_progress(points: DataFrame, step: str, by: str = KEY) -> DataFrame:
    """k/(L-1) along an experiment's points, 0 where it has one.

    ``step`` must count 0, 1, 2, …, so the last one gives L and no window is needed.
    """
    ends = points.groupBy(by).agg(F.max(step).alias("_last"))
    return (
        points.join(ends, by)
        .withColumn("progress", F.col(step) / F.greatest(F.col("_last"), F.lit(1)))
        .drop("_last")
    )


def axis_steps(rows: DataFrame, by: list[str], axis: str) -> DataFrame:
    """Rank of the distinct index values along one axis (bounded by the axis size)."""
    w = Window.partitionBy(*by).orderBy(axis)
    return rows.select(*by, axis).distinct().withColumn("step", F.row_number().over(w) - 1)
