"""Weighted point sets and Gaussian sums on a bounded grid of nodes.

A sum of many smooth kernels does not need the kernels one by one. The unit domain is cut into
cells no wider than the kernel; inside a cell a point's weight is spread over a few Chebyshev
nodes so that sums of smooth functions keep their value to about ten digits. The spread is a plain
sum per cell, so each task adds up its own part however the points are clumped, and what comes
out is bounded by the domain and the kernel width, never by the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 40_000_000


@dataclass(frozen=True)
class Line:
    """Cells of width ``h`` from ``lo`` on, each with ``m`` nodes."""

    lo: float
    h: float
    cells: int
    m: int

    @classmethod
    def over(cls, lo: float, hi: float, h: float, m: int) -> Line:
        return cls(lo, h, max(1, ceil((hi - lo) / h - 1e-9)), m)

    @property
    def hi(self) -> float:
        return self.lo + self.h * self.cells

    @property
    def unit_nodes(self) -> np.ndarray:
        return np.cos(np.pi * (np.arange(self.m) + 0.5) / self.m)

    @property
    def nodes(self) -> np.ndarray:
        mid = self.lo + self.h * (np.arange(self.cells) + 0.5)
        return (mid[:, None] + 0.5 * self.h * self.unit_nodes[None, :]).ravel()

    def transform(self) -> np.ndarray:
        """(node, order) matrix between node values and Chebyshev orders of one cell."""
        k = np.arange(self.m)
        t = np.cos(k[None, :] * np.arccos(self.unit_nodes)[:, None])
        return t * np.where(k == 0, 1.0, 2.0)[None, :] / self.m

    def cell_of(self, z: np.ndarray) -> np.ndarray:
        return np.clip(((z - self.lo) / self.h).astype(np.int64), 0, self.cells - 1)

    def polynomials(self, z: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Chebyshev polynomials (m, n) of points in their cells."""
        u = np.clip(2 * ((z - self.lo) / self.h - cell) - 1, -1.0, 1.0)
        t = np.empty((self.m, len(u)))
        t[0] = 1.0
        if self.m > 1:
            t[1] = u
        for k in range(2, self.m):
            np.multiply(2 * u, t[k - 1], out=t[k])
            t[k] -= t[k - 2]
        return t

    def place(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and polynomials (n, m) of points on the line."""
        cell = self.cell_of(z)
        return cell, self.polynomials(z, cell).T


def _apply(tensor: np.ndarray, dim: int, matrix: np.ndarray) -> np.ndarray:
    return np.moveaxis(np.tensordot(matrix, tensor, axes=(1, dim)), 0, dim)


def check_size(lines: tuple[Line, ...]) -> None:
    size = 1
    for line in lines:
        size *= line.cells * line.m
    if size > MAX_NODES:
        raise ValueError(
            f"{size} nodes over {len(lines)} dimensions; use a wider kernel, fewer dimensions or the marginal estimate alone"
        )


@dataclass(frozen=True)
class Measure:
    """A weighted point set made from kernels: some of their coordinates, moved by offsets.

    Points outside ``bounds`` are left out; ``lines`` are the cells they are summed into.
    """

    dims: tuple[int, ...]
    lines: tuple[Line, ...]
    offsets: np.ndarray
    weights: np.ndarray
    bounds: tuple[tuple[float, float], ...] | None = None

    @classmethod
    def of_centers(cls, dims: tuple[int, ...], lines: tuple[Line, ...]) -> Measure:
        return cls(dims, lines, np.zeros((1, len(dims))), np.ones(1))

    def moments(self, z: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, Chebyshev moments) of a batch of kernels; the last order is the last axis."""
        y = (z[:, None, self.dims] + self.offsets[None]).reshape(-1, len(self.dims))
        v = np.outer(w, self.weights).ravel()
        if self.bounds is not None:
            lo, hi = np.array(self.bounds).T
            inside = ((y >= lo) & (y <= hi)).all(axis=1)
            y, v = y[inside], v[inside]
        if len(y) == 0:
            return
        flat = np.zeros(len(y), dtype=np.int64)
        for d, line in enumerate(self.lines):
            flat = flat * line.cells + line.cell_of(y[:, d])
        # Few cells fit 16 bits, which sort in linear time.
        order = np.argsort(flat.astype(np.uint16) if flat.max() < 1 << 16 else flat, kind="stable")
        flat, y, v = flat[order], y[order], v[order]
        polys = [line.polynomials(y[:, d], line.cell_of(y[:, d])) for d, line in enumerate(self.lines)]
        right = polys[-1] * v
        starts = np.flatnonzero(np.diff(flat, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(flat)]):
            left = np.ones((1, b - a))
            for t in polys[:-1]:
                left = (left[:, None, :] * t[None, :, a:b]).reshape(-1, b - a)
            yield int(flat[a]), left @ right[:, a:b].T


def node_weights(kernels: DataFrame, dims: list[str], weight: str, measures: list[Measure], by: str) -> list[dict]:
    """Node weight tensors {group: tensor} of each measure, all from one pass over the kernels.

    A task adds up its own part and emits one row per occupied cell and order, so the shuffle does
    not grow with the kernels. ``by`` must hold declared names (models): each has its tensors.
    """
    for m in measures:
        check_size(m.lines)
    width = max(m.lines[-1].m for m in measures)
    names = [f"s{k}" for k in range(width)]
    kind = kernels.schema[by].dataType.simpleString()

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for part in parts:
            for group, rows in part.groupby(by, dropna=False, sort=False):
                z, w = rows[dims].to_numpy(dtype=float), rows[weight].to_numpy(dtype=float)
                for i, measure in enumerate(measures):
                    for cell, moment in measure.moments(z, w):
                        key = (group, i, cell)
                        sums[key] = sums[key] + moment if key in sums else moment
        entries = list(sums.items())
        for at in range(0, len(entries), 1000):
            some = entries[at : at + 1000]
            full = np.zeros((sum(len(m) for _, m in some), width))
            ends = np.cumsum([len(m) for _, m in some])
            for (_, moment), end in zip(some, ends):
                full[end - len(moment) : end, : moment.shape[1]] = moment
            sizes = [len(m) for _, m in some]
            out = pd.DataFrame(full, columns=names)
            out.insert(0, "r", np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))
            out.insert(0, "cell", np.repeat(np.array([k[2] for k, _ in some], dtype=np.int64), sizes))
            out.insert(0, "i", np.repeat(np.array([k[1] for k, _ in some], dtype=np.int32), sizes))
            out.insert(0, by, np.repeat(np.array([k[0] for k, _ in some]), sizes))
            yield out

    schema = f"{by} {kind}, i int, cell bigint, r int, " + ", ".join(f"{n} double" for n in names)
    partial = kernels.select(by, *dims, weight).mapInPandas(add_up, schema)
    total = partial.groupBy(by, "i", "cell", "r").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out: list[dict] = [{} for _ in measures]
    for row in total:
        lines = measures[row["i"]].lines
        table = out[row["i"]]
        if row[by] not in table:
            table[row[by]] = np.zeros([n for line in lines for n in (line.cells, line.m)])
        cells = np.unravel_index(row["cell"], [line.cells for line in lines])
        orders = np.unravel_index(row["r"], [line.m for line in lines[:-1]]) if len(lines) > 1 else ()
        where = [x for d in range(len(lines) - 1) for x in (cells[d], orders[d])]
        table[row[by]][(*where, cells[-1])] = row[4 : 4 + lines[-1].m]
    for measure, table in zip(measures, out):
        for group, tensor in table.items():
            for d, line in enumerate(measure.lines):
                tensor = _apply(tensor, 2 * d + 1, line.transform())
            table[group] = tensor.reshape([line.cells * line.m for line in measure.lines])
    return out


@dataclass(frozen=True)
class GaussField:
    """ρ(z) = Σ w exp(-‖z - c‖² / 2σ²) of any number of kernels, evaluated in constant time."""

    sigma: float
    lines: tuple[Line, ...]
    sources: np.ndarray
    coef: np.ndarray

    @classmethod
    def build(cls, sigma: float, lines: list[Line], sources: np.ndarray) -> GaussField:
        values = sources
        for d, line in enumerate(lines):
            y = line.nodes
            values = _apply(values, d, np.exp(-((y[:, None] - y[None, :]) ** 2) / (2 * sigma**2)))
        coef = values.reshape([n for line in lines for n in (line.cells, line.m)])
        for d, line in enumerate(lines):
            coef = _apply(coef, 2 * d + 1, line.transform().T)
        return cls(sigma, tuple(lines), sources, coef)

    def plus(self, points: np.ndarray, weights: np.ndarray) -> GaussField:
        """The field with a few more kernels."""
        add = self.sources.copy()
        for z, w in zip(np.atleast_2d(points), weights):
            term = np.array(float(w))
            spot = []
            for line, x in zip(self.lines, z):
                cell, t = line.place(np.array([x]))
                term = np.multiply.outer(term, line.transform() @ t[0])
                spot.append(slice(int(cell[0]) * line.m, (int(cell[0]) + 1) * line.m))
            add[tuple(spot)] += term
        return GaussField.build(self.sigma, list(self.lines), add)

    def at(self, z: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """ρ at points (n, D)."""
        z = np.atleast_2d(np.asarray(z, dtype=float))
        if len(z) > chunk:
            return np.concatenate([self.at(z[i : i + chunk], chunk) for i in range(0, len(z), chunk)])
        inside = np.ones(len(z), dtype=bool)
        for d, line in enumerate(self.lines):
            inside &= (z[:, d] >= line.lo) & (z[:, d] <= line.hi)
        out = np.empty(len(z))
        if inside.any():
            index, polys = [], []
            for d, line in enumerate(self.lines):
                cell, t = line.place(z[inside, d])
                index += [cell, slice(None)]
                polys.append(t)
            got = self.coef[tuple(index)]
            for t in reversed(polys):
                got = np.einsum("n...k,nk->n...", got, t)
            out[inside] = got
        if not inside.all():
            out[~inside] = self._direct(z[~inside])
        return np.maximum(out, 0.0)

    def _direct(self, z: np.ndarray) -> np.ndarray:
        """Points outside the cells, from the node weights themselves."""
        out = np.empty(len(z))
        for i, point in enumerate(z):
            got = self.sources
            for line, x in zip(self.lines, point):
                got = np.tensordot(np.exp(-((line.nodes - x) ** 2) / (2 * self.sigma**2)), got, axes=(0, 0))
            out[i] = got
        return out

    def on_nodes(self, lines: list[Line]) -> np.ndarray:
        """ρ on another tensor grid of nodes."""
        values = self.sources
        for d, (line, own) in enumerate(zip(lines, self.lines)):
            y, s = line.nodes, own.nodes
            values = _apply(values, d, np.exp(-((y[:, None] - s[None, :]) ** 2) / (2 * self.sigma**2)))
        return np.maximum(values, 0.0)


