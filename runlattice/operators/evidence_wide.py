"""Density, integrals and gain over any extent and any number of dimensions, as plans over rows.

Same formulas as ``operators.evidence``, without its grid of nodes: no bound is too wide, no outlier too far, no kernel too
narrow. Space counts only where something lies. A cell no wider than the kernel that holds more rows than nodes is
replaced by its nodes with weights that keep sums of smooth functions to about ten digits (a fast Gauss transform, kept
as rows of points), so a crowd costs what its nodes cost. What is left meets within reach, block by block. Reach grows
with the total weight, so what lies beyond it never adds up to more than TOLERANCE.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.functions.blocks import sums_in_reach
from runlattice.functions.nodes import Line
from runlattice.operators.evidence import BOX, axis_probes, cube_probes, in_bounds, resolve_sigma, shell_probes
from runlattice.session import checkpointed

TOLERANCE = 1e-9
#: Cell width in σ and nodes a dimension, for kernels and for probes.
KERNEL_CELLS, PROBE_CELLS = (1.0, 14), (0.5, 12)
#: Dimensions up to which a crowd is replaced by its nodes; beyond, their number is larger than most crowds.
NODE_DIMS = 3
#: Crowded cells that are sent to every task, at most; more of them are merged with the rows by key.
FEW = 1 << 17
#: Points that cost about as much as one kernel with all its probes by a product of matrices.
WORTH = 4
#: Marginal sums of all axes run side by side: the number of the axis is one more coordinate, this many reaches apart.
APART = 4.0
Bounds = list[tuple[float, float]]


def _merged(kernels: DataFrame, dims: list[str], weight: str) -> DataFrame:
    """Kernels of one position as one."""
    return kernels.groupBy(*[F.col(d).cast("double").alias(d) for d in dims]).agg(F.sum(weight).cast("double").alias("w"))


def _reach(kernels: DataFrame, sigma: float) -> float:
    total = kernels.agg(F.sum("w").alias("w")).first()["w"] or 0.0
    return sigma * sqrt(2 * log(max(total, 1.0) / TOLERANCE))


#: Squared distance from the middle, in units of the exponent, up to which it may be taken from products: error under 1e-12.
NEAR2 = 1e3
#: Largest exponent of the factors of a probe's sum; farther blocks are compared probe by probe.
FACTOR_MAX = 300.0


def _near(points: np.ndarray, sources: np.ndarray, n: int, sigma: float) -> np.ndarray:
    middle = points[:, :n].mean(axis=0)
    p, s = ((x[:, :n] - middle) / (sigma * sqrt(2)) for x in (points, sources))
    p2, s2 = (p**2).sum(axis=1), (s**2).sum(axis=1)
    if max(p2.max(initial=0.0), s2.max(initial=0.0)) <= NEAR2:
        out = p @ (2 * s.T)
        out -= p2[:, None]
        out -= s2[None, :]
        return np.exp(np.minimum(out, 0.0, out=out), out=out)
    d2 = np.zeros((len(points), len(sources)))
    for k in range(n):
        d2 += (points[:, k][:, None] - sources[:, k][None, :]) ** 2
    return np.exp(-d2 / (2 * sigma**2))


def _around(points: np.ndarray, sources: np.ndarray, n: int, sigma: float, offsets: np.ndarray) -> np.ndarray:
    """Density (point, probe) that the sources give at each point's probes.

    With x a point, o an offset and k a kernel, exp(-|x + o - k|²/2σ²) is exp(-|x - k|²/2σ²) times a factor of k and o and one
    of x and o, so the probes of a point cost a product of matrices instead of a distance each.
    """
    middle = points[:, :n].mean(axis=0)
    x, k = ((r[:, :n] - middle) @ offsets.T / sigma**2 for r in (points, sources))
    if max(np.abs(x).max(initial=0.0), np.abs(k).max(initial=0.0)) > FACTOR_MAX:
        return np.column_stack([_near(points[:, :n] + o, sources, n, sigma) @ sources[:, n] for o in offsets])
    total = _near(points, sources, n, sigma) @ (sources[:, n][:, None] * np.exp(k))
    return total * np.exp(-x - (offsets**2).sum(axis=1) / (2 * sigma**2))


#: Terms of the series of what a probe loses, at most, and what its last one may leave, as a share of the first.
ORDERS, REST = 4, 1e-10


def _taken(points: np.ndarray, kernels: np.ndarray, n: int, sigma: float, offsets: np.ndarray, weights: np.ndarray, bounds: Bounds) -> np.ndarray:
    """What the probes of the kernels lose to each point: the sum of v δ / ((1 + ρ)(1 + ρ + δ)) over in-bounds probes.

    Points are rows (z, w), kernels (z, w, ρ of each probe). δ is w times factors as in ``_around``. Where it is small next to 1 + ρ,
    the terms of its series are products of matrices; elsewhere probes are taken one offset at a time.
    """
    z, w, k, full = points[:, :n], points[:, n], kernels[:, :n], 1.0 + kernels[:, n + 1 :]
    lo, hi = np.array(bounds).T
    y = k[:, None] + offsets
    share = kernels[:, n][:, None] * weights * ((y >= lo) & (y <= hi)).all(axis=2) / full
    close, lengths = _near(points, kernels, n, sigma), (offsets**2).sum(axis=1)
    a, b = ((r - z.mean(axis=0)) @ offsets.T / sigma**2 for r in (z, k))
    largest = max(np.abs(a).max(), np.abs(b).max())
    total = np.zeros(len(points))
    if largest * max(ORDERS, 1) > FACTOR_MAX:
        for o, offset in enumerate(offsets):
            delta = _near(points, k + offset, n, sigma) * w[:, None]
            total += (delta / (delta + full[:, o])) @ share[:, o]
        return total
    front, back = np.exp(-b), np.exp(a - lengths / (2 * sigma**2)) * w[:, None]
    # The largest δ / (1 + ρ) of each point, by its nearest kernel, says whether so many terms leave no more than REST.
    gap = np.sqrt(-2 * np.log(np.clip(close.max(axis=1), 1e-300, 1.0))) - np.sqrt(lengths.max()) / sigma
    worst = np.abs(w) * np.exp(-(np.maximum(gap, 0.0) ** 2) / 2) / full.min()
    few = worst**ORDERS <= REST
    if not few.all():
        near, at, sums = close[~few], back[~few], np.zeros(np.count_nonzero(~few))
        for o in range(len(offsets)):
            delta = near * front[:, o]
            delta *= at[:, o][:, None]
            delta /= delta + full[:, o]
            sums += delta @ share[:, o]
        total[~few] = sums
    if few.any():
        c, f, g = step = close[few], front / full, back[few]
        sums, ratio = ((c @ (share * f)) * g).sum(axis=1), worst[few].max()
        left = ratio
        while left > REST:
            c, f, g, left = c * step[0], f * step[1], -g * step[2], left * ratio
            sums += ((c @ (share * f)) * g).sum(axis=1)
        total[few] = sums
    return total


def _in_cells(rows: DataFrame, along: list[str], fixed: list[str], width: float, *more: Column) -> DataFrame:
    own = rows.select(*fixed, *[F.col(d).cast("double").alias(d) for d in along], *more)
    return own.withColumns({f"_c{i}": F.floor(F.col(d) / width).cast("long") for i, d in enumerate(along)})


def crowds(rows: DataFrame, along: list[str], fixed: list[str], width: float, nodes: int) -> DataFrame:
    """The cells (fixed, _c0, …) with more rows than nodes, and how many (``_n``); counted once."""
    cells = _in_cells(rows, along, fixed, width).groupBy(*fixed, *[f"_c{i}" for i in range(len(along))])
    return checkpointed(cells.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > nodes ** len(along)))


def thinned(
    rows: DataFrame, along: list[str], fixed: list[str], weight: str, width: float, nodes: int, crowded: DataFrame | None = None
) -> DataFrame:
    """The rows (fixed, along, weight), with the nodes of a cell in place of its rows where these are more.

    ``along`` names the coordinates cut into cells of ``width``; rows of different ``fixed`` columns don't mix. A task adds up its
    own part of each crowded cell (``crowded``: the ``crowds`` of the rows, if they have been counted).
    """
    if len(along) > NODE_DIMS:
        return rows.select(*fixed, *along, weight)
    line = Line(0.0, 1.0, 1, nodes)
    spots = (line.nodes).tolist()
    basis = line.transform()
    cells = [f"_c{i}" for i in range(len(along))]
    keys = [*fixed, *cells]
    own = _in_cells(rows, along, fixed, width, F.col(weight).cast("double").alias(weight))
    crowded = (crowds(rows, along, fixed, width, nodes) if crowded is None else crowded).select(*keys)
    count = crowded.count()
    if not count:
        return own.select(*fixed, *along, weight)
    # Spark takes exploded rows for as small as the rows before them, and would send them, not the cells, to every task.
    crowded = F.broadcast(crowded) if count <= FEW else crowded.hint("merge")
    lone = own.join(crowded, keys, "left_anti").select(*fixed, *along, weight)
    heads, names = len(cells) - 1, [f"_s{k}" for k in range(nodes)]
    first = len(fixed)

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for part in parts:
            for key, some in part.groupby(keys, sort=False):
                place = key if isinstance(key, tuple) else (key,)
                spread = some[weight].to_numpy()[None, :]
                for c, d in zip(place[first:], along):
                    share = basis @ line.polynomials(np.clip(some[d].to_numpy() / width - c, 0.0, 1.0), np.zeros(len(some)))
                    spread = (spread[:, None, :] * share[None, :, :]).reshape(-1, len(some)) if d != along[-1] else spread @ share.T
                sums[place] = sums[place] + spread if place in sums else spread
        for place, total in sums.items():
            out = pd.DataFrame(total, columns=names)
            for i, (k, v) in enumerate(zip(keys, place)):
                out.insert(i, k, v)
            out.insert(len(keys), "_r", np.arange(len(total), dtype=np.int32))
            yield out

    typed = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    dense = own.join(crowded, keys).select(*keys, *along, weight)
    added = dense.mapInPandas(add_up, f"{typed}, _r int, " + ", ".join(f"{n} double" for n in names))
    total = added.groupBy(*keys, "_r").agg(*[F.sum(n).alias(n) for n in names])
    spread = total.select(*keys, "_r", F.posexplode(F.array(*names)).alias("_k", weight))
    at = F.array(*map(F.lit, spots))
    # The row number holds the nodes of all coordinates but the last, the later ones first.
    order = [F.floor(F.col("_r") / nodes ** (heads - 1 - i)) % nodes for i in range(heads)] + [F.col("_k")]
    placed = [((F.col(c) + F.get(at, o.cast("int"))) * width).alias(d) for c, d, o in zip(cells, along, order)]
    return lone.unionByName(spread.select(*fixed, *placed, weight))


def density(points: DataFrame, kernels: DataFrame, dims: list[str], radius: float, weight: str = "w", name: str = "density") -> DataFrame:
    """Add the density at each point."""
    sigma = resolve_sigma(radius)
    return _with_density(points, _sources(_merged(kernels, dims, weight), dims, [], sigma), dims, sigma, name)


def _sources(merged: DataFrame, along: list[str], fixed: list[str], sigma: float) -> DataFrame:
    # Read several times over: for its extent, its splits and its sums.
    return checkpointed(thinned(merged, along, fixed, "w", KERNEL_CELLS[0] * sigma, KERNEL_CELLS[1]))


def _with_density(points: DataFrame, sources: DataFrame, coords: list[str], sigma: float, name: str) -> DataFrame:
    n = len(coords)

    def rho(p: np.ndarray, s: np.ndarray) -> np.ndarray:
        return _near(p, s, n, sigma) @ s[:, n]

    found = sums_in_reach(points, sources, coords, [], ["w"], _reach(sources, sigma), rho, name)
    # As many sums as points: never broadcast, whatever Spark takes arrays and Python's rows to weigh.
    return points.join(found.hint("merge"), coords, "left").withColumn(name, F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(0.0)))


def _moved(table: DataFrame, coords: list[str], offsets: np.ndarray, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Probes around each row's position with their quadrature weight ``v``."""
    packed = F.array(
        *[F.struct(*[F.lit(float(x)).alias(f"o{i}") for i, x in enumerate(o)], F.lit(float(w)).alias("ow")) for o, w in zip(offsets, weights)]
    )
    return table.withColumn("_o", F.explode(packed)).select(
        *keep, *[(F.col(d) + F.col(f"_o.o{i}")).alias(d) for i, d in enumerate(coords)], (F.col("w") * F.col("_o.ow")).alias("v")
    )


class _Frame:
    """Where an integral takes its sums: all coordinates together, or one axis each side by side."""

    def __init__(self, dims: list[str], sigma: float, bounds: Bounds | None, probes: tuple[np.ndarray, np.ndarray] | None = None):
        self.dims, self.sigma, self.probes = dims, sigma, probes
        self.bounds = bounds or [(0.0, 1.0)] * len(dims)
        self.joint = probes is not None
        self.along = dims if self.joint else ["z"]
        self.fixed = [] if self.joint else ["_g"]
        self.coords = [*self.along, *self.fixed]

    def rows(self, table: DataFrame, far: float, keep: list[str]) -> DataFrame:
        """Positions of the table in this frame, with ``w`` and the kept columns."""
        if self.joint:
            return table.select(*keep, *self.dims, "w")
        line = F.explode(F.array(*[F.struct(F.lit(i * APART * far).alias("_g"), F.col(d).alias("z")) for i, d in enumerate(self.dims)]))
        return table.select(*keep, line.alias("_x"), "w").select(*keep, "_x.z", "_x._g", "w")

    def around(self, rows: DataFrame, far: float, keep: list[str]) -> DataFrame:
        """In-bounds probes around rows of this frame."""
        if self.joint:
            return _moved(rows, self.dims, *self.probes, keep).where(in_bounds(self.dims, self.bounds))
        p, q = axis_probes(self.sigma)
        spots = _moved(rows, ["z"], p[:, None], q, [*keep, "_g"])
        return spots.where(reduce(lambda a, b: a | b, [(F.col("_g") == i * APART * far) & F.col("z").between(*e) for i, e in enumerate(self.bounds)]))

    def around_each(self, rows: DataFrame, sources: DataFrame, far: float, keep: list[str]) -> DataFrame:
        """The rows (kept columns, coordinates, ``w``) with the densities at all probes around each as an array ``_rho``."""
        n, sigma, offsets = len(self.dims), self.sigma, self.probes[0]
        reach = far + float(np.sqrt((offsets**2).sum(axis=1)).max())

        def sums(p: np.ndarray, s: np.ndarray) -> np.ndarray:
            return _around(p, s, n, sigma, offsets)

        found = sums_in_reach(rows.select(*self.dims), sources, self.dims, [], ["w"], reach, sums, "_rho", lambda p, total: total, len(offsets))
        doubles = rows.withColumns({d: F.col(d).cast("double") for d in self.dims})
        none = F.array_repeat(F.lit(0.0), len(offsets))
        return doubles.join(found.hint("merge"), self.dims, "left").select(*keep, *self.dims, "w", F.coalesce("_rho", none).alias("_rho"))

    def opened(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The in-bounds probes of rows with ``_rho``: kept columns, coordinates, ``v`` and ``rho``."""
        places = F.array(*[F.struct(*[F.lit(float(x)).alias(f"o{i}") for i, x in enumerate(o)], F.lit(float(w)).alias("ow")) for o, w in zip(*self.probes)])
        spots = rows.select(*keep, *self.dims, "w", "_rho", F.posexplode(places).alias("_i", "_o"))
        moved = spots.select(
            *keep, *[(F.col(d) + F.col(f"_o.o{i}")).alias(d) for i, d in enumerate(self.dims)], (F.col("w") * F.col("_o.ow")).alias("v"),
            F.get("_rho", F.col("_i")).alias("rho"),
        )
        return moved.where(in_bounds(self.dims, self.bounds))

    def probed(self, rows: DataFrame, sources: DataFrame, far: float, keep: list[str]) -> DataFrame:
        """In-bounds probes around rows of this frame: kept columns, coordinates, ``v`` and density ``rho``."""
        if not self.joint:
            return _with_density(self.around(rows, far, keep), sources, self.coords, self.sigma, "rho")
        return self.opened(self.around_each(rows, sources, far, keep), keep)

    def field(self, merged: DataFrame, far: float) -> tuple[DataFrame, DataFrame]:
        """Thinned kernels, and thinned probes (coordinates, v, rho), or a row a kernel with the densities at its probes as ``_rho``."""
        rows = _merged(self.rows(merged, far, []), self.coords, "w")
        sources = _sources(rows, self.along, self.fixed, self.sigma)
        if self.joint and len(self.dims) > NODE_DIMS:
            return sources, self.around_each(rows, sources, far, [])
        spots, width, nodes = self.around(rows, far, []), PROBE_CELLS[0] * self.sigma, PROBE_CELLS[1]
        crowded = crowds(spots, self.along, self.fixed, width, nodes)
        if self.joint:
            saved = crowded.agg(F.sum(F.col("_n") - nodes ** len(self.along)).alias("n")).first()["n"] or 0
            if rows.count() * (len(self.probes[0]) - WORTH) > saved:
                return sources, self.around_each(rows, sources, far, [])
        spots = thinned(spots, self.along, self.fixed, "v", width, nodes, crowded)
        return sources, _with_density(checkpointed(spots), sources, self.coords, self.sigma, "rho")

    def integral(self, kernels: DataFrame) -> DataFrame:
        merged = checkpointed(_merged(kernels, self.dims, "w"))
        _, field = self.field(merged, _reach(merged, self.sigma))
        if "_rho" in field.columns:
            field = self.opened(field, [])
        share = 1.0 if self.joint else 1.0 / len(self.dims)
        return field.agg((F.coalesce(F.sum(F.col("v") / (1 + F.col("rho"))), F.lit(0.0)) * share).alias("integral"))

    def lost(self, points: DataFrame, field: DataFrame, far: float) -> DataFrame:
        """(coordinates, w, _lost): what the field loses to points of weight ``w``."""
        n, sigma, coords, bounds = len(self.coords), self.sigma, self.coords, self.bounds
        if "_rho" in field.columns:
            # Kernels with the densities at their probes travel, not the probes.
            offsets, weights = self.probes
            full = F.aggregate(
                F.zip_with("_rho", F.array(*[F.lit(float(x)) for x in weights]), lambda r, o: o / ((1 + r) * (1 + r))), F.lit(0.0), lambda a, x: a + x
            )
            total = (field.agg(F.sum(F.col("w") * full).alias("t")).first()["t"] or 0.0) * max(1.0, points.agg(F.max("w").alias("w")).first()["w"] or 0.0)
            reach = sigma * sqrt(2 * log(max(total / TOLERANCE, 1.0))) + float(np.sqrt((offsets**2).sum(axis=1)).max())

            def from_kernels(p: np.ndarray, s: np.ndarray) -> np.ndarray:
                return _taken(p, s, n, sigma, offsets, weights, bounds)

            return sums_in_reach(points, field, coords, ["w"], ["w"], reach, from_kernels, "_lost", more=("_rho", len(offsets)))

        def from_probes(p: np.ndarray, s: np.ndarray) -> np.ndarray:
            v, rho = s[:, n], s[:, n + 1]
            delta = _near(p, s, n, sigma)
            delta *= p[:, n][:, None]
            delta /= delta + (1 + rho)
            return delta @ (v / (1 + rho))

        return sums_in_reach(points, field, coords, ["w"], ["v", "rho"], far, from_probes, "_lost")

    def gain(self, spot: DataFrame, kernels: DataFrame, key: str, name: str) -> DataFrame:
        """(key, name): change of the integral when a candidate of weight ``w`` is added."""
        merged = checkpointed(_merged(kernels, self.dims, "w"))
        far = _reach(merged, self.sigma)
        sources, field = self.field(merged, far)
        field = checkpointed(field)
        placed = self.rows(spot, far, [key])
        taken = self.lost(placed.select(*self.coords, "w"), field, far)
        # As many sums as candidates: never broadcast.
        paid = placed.join(taken.hint("merge"), [*self.coords, "w"], "left").groupBy(key).agg(F.coalesce(F.sum("_lost"), F.lit(0.0)).alias("_paid"))
        sigma, coords = self.sigma, self.coords
        centers = [f"_x{i}" for i in range(len(coords))]
        centred = placed.withColumns({x: F.col(c) for x, c in zip(centers, coords)}).withColumn("_w", F.col("w"))
        own = self.probed(centred, sources, far, [key, "_w", *centers])
        d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(x)) ** 2 for c, x in zip(coords, centers)])
        added = F.col("rho") + F.col("_w") * F.exp(-d2 / (2 * sigma**2))
        won = own.groupBy(key).agg(F.sum(F.col("v") / (1 + added)).alias("_won"))
        share = 1.0 if self.joint else 1.0 / len(self.dims)
        return paid.join(won.hint("merge"), key, "left").select(key, ((F.coalesce("_won", F.lit(0.0)) - F.col("_paid")) * share).alias(name))


def _probes(estimator: str, dims: int, sigma: float, n_samples: int | None, box: float) -> tuple[np.ndarray, np.ndarray]:
    if estimator not in ("shell", "cube"):
        raise ValueError(f"unknown estimator {estimator!r}")
    return shell_probes(dims, sigma) if estimator == "shell" else cube_probes(dims, sigma, n_samples, box)


def marginal_integral(kernels: DataFrame, dims: list[str], radius: float, weight: str = "w", bounds: Bounds | None = None) -> DataFrame:
    """Mean over the axes of the evidence along each."""
    return _Frame(dims, resolve_sigma(radius), bounds).integral(_merged(kernels, dims, weight))


def joint_integral(
    kernels: DataFrame, dims: list[str], radius: float, weight: str = "w", bounds: Bounds | None = None,
    estimator: str = "shell", n_samples: int | None = None, box: float = BOX,
) -> DataFrame:
    """Evidence of all coordinates together, by probes on shells or in a cube around each kernel."""
    sigma = resolve_sigma(radius)
    return _Frame(dims, sigma, bounds, _probes(estimator, len(dims), sigma, n_samples, box)).integral(_merged(kernels, dims, weight))


def integral(kernels: DataFrame, dims: list[str], radius: float, weight: str = "w", bounds: Bounds | None = None) -> DataFrame:
    """Marginal and joint integral, blended by D / (D + 1)."""
    share = len(dims) / (len(dims) + 1)
    axis = marginal_integral(kernels, dims, radius, weight, bounds).select(F.col("integral").alias("axis"))
    joint = joint_integral(kernels, dims, radius, weight, bounds)
    return joint.crossJoin(axis).select((share * F.col("axis") + (1 - share) * F.col("integral")).alias("integral"))  # a row each


def gain(
    candidates: DataFrame, kernels: DataFrame, dims: list[str], radius: float, weight: str = "w", key: str = "cand_id", name: str = "gain",
    bounds: Bounds | None = None, estimator: str = "shell", candidate_weight: Column | None = None,
) -> DataFrame:
    """Add ΔE of candidates of one point each, of weight 1 unless given."""
    sigma, n = resolve_sigma(radius), len(dims)
    own = F.lit(1.0) if candidate_weight is None else candidate_weight.cast("double")
    spot = candidates.select(key, *[F.col(d).cast("double").alias(d) for d in dims], own.alias("w"))
    merged = checkpointed(_merged(kernels, dims, weight))
    joint = _Frame(dims, sigma, bounds, _probes(estimator, n, sigma, None, BOX)).gain(spot, merged, key, "_joint")
    if estimator == "cube":
        return candidates.join(joint.withColumnRenamed("_joint", name).hint("merge"), key)
    axis = _Frame(dims, sigma, bounds).gain(spot, merged, key, "_axis")
    share = n / (n + 1)
    both = axis.join(joint.hint("merge"), key).select(key, (share * F.col("_axis") + (1 - share) * F.col("_joint")).alias(name))
    return candidates.join(both.hint("merge"), key)
