"""User-defined features computed at every cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlattice.operators.asof import effective_params
from runlattice.operators.grid import KEY
from runlattice.schema import Axis


def extract(
    experiments: DataFrame,
    updates: DataFrame,
    axes: list[Axis],
    params: list[str],
    outputs: dict[str, Column] | None = None,
    function: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    names: list[str] = (),
    raw: DataFrame | None = None,
    upstream: DataFrame | None = None,
    start: int = 0,
    stop: int | None = None,
) -> DataFrame:
    """Features per cell from the parameters in force there (row rule).

    Give ``outputs`` as column expressions, or a ``function`` from a batch of cells to the
    columns ``names``. ``raw`` and ``upstream`` tables join by cell first, so user code sees
    measured data and the features of earlier models.
    """
    cells = effective_params(experiments, updates, axes, params, mode="row")
    if start or stop is not None:
        cells = cells.where((F.col("cell_idx") >= start) & (F.col("cell_idx") < (stop if stop is not None else 2**62)))
    index = [a.index for a in axes]
    for extra in (raw, upstream):
        if extra is not None:
            cells = cells.join(extra, [KEY, *index], "left")
    keep = [KEY, "cell_idx", *index]
    if outputs is not None:
        checked = cells.select(*keep, *[c.alias(n) for n, c in outputs.items()])
        for n in outputs:
            if not isinstance(checked.schema[n].dataType, T.NumericType):
                raise TypeError(f"feature {n!r} is not a number")
        return checked.withColumns({n: F.col(n).cast("double") for n in outputs})
    if function is None:
        raise ValueError("give column expressions or a function")
    return map_cells(cells, keep, function, list(names))


def map_cells(
    cells: DataFrame, keep: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]
) -> DataFrame:
    """Call a vectorised user function on Arrow batches of cells."""
    schema = T.StructType([cells.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = function(part)
            for n in names:
                if not pd.api.types.is_numeric_dtype(made[n]):
                    raise TypeError(f"feature {n!r} is not a number")
            yield pd.concat([part[keep], made[names].astype("float64")], axis=1)

    return cells.mapInPandas(run, schema)


def pending(experiments: DataFrame, complete: DataFrame, outputs: list[str], recompute: bool = False, only: str | None = None) -> DataFrame:
    """(key, output) still to be computed: a model is skipped where all its outputs are complete.

    ``complete`` has one row per (key, feature) that is complete in the asked range.
    """
    wanted = outputs if only is None else [o for o in outputs if only.lower() in o.lower()]
    if not wanted:
        return experiments.select(KEY, F.lit("").alias("feature")).where("false")
    if recompute:
        open_keys = experiments.select(KEY)
    else:
        done = (
            complete.where(F.col("feature").isin(*outputs))
            .groupBy(KEY)
            .agg(F.count_distinct("feature").alias("_n"))
            .where(F.col("_n") == len(outputs))
        )
        open_keys = experiments.select(KEY).join(done.select(KEY), KEY, "left_anti")
    return open_keys.select(KEY, F.explode(F.lit(wanted)).alias("feature"))


def split_outputs(wide: DataFrame, keep: list[str], outputs: list[str]) -> DataFrame:
    """One row per cell and output: (keep…, feature, value)."""
    return wide.unpivot(keep, outputs, "feature", "value")
