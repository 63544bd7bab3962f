"""Sums over everything within reach of a point, block by block, for spaces of any extent and number of dimensions.

A tree of splits, built from a bounded sample of the sources, cuts space into leaves that hold about equally many of them,
however they clump. Points and sources are packed leaf by leaf into blocks of bounded size with the box that they fill. Blocks of
points that lie next to each other form groups, and a block of sources goes once to each group that has a box within reach. A task
holds the points of a group, reads sources one block after the other, and adds up those within reach of each block of points; what
is never compared is known to be farther away. Where points are few next to sources, a group is so large that its sources are dealt
over several tasks, whose sums per block of points are added up in one more step. So copies of sources grow with the
root of points times sources, not with their product, and pairs of rows are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.session import checkpointed, spread

BLOCK = 256
#: Blocks of points that there should be, and rows that one holds at most.
TASKS, MOST = 128, 8 * BLOCK
#: Sources that the splits are taken from, about, and leaves, at most.
SAMPLE, LEAVES = 1 << 16, 1 << 12
#: Numbers of points and their sums that a task holds, about, and numbers in a block of sources, at most.
HELD, WIDEST = 1 << 21, 1 << 14


@dataclass(frozen=True)
class Splits:
    """A complete binary tree: node i cuts dimension dim[i] at value[i]; its halves are 2i + 1 and 2i + 2."""

    dim: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, depth: int) -> Splits:
        dim, value = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        parts = [sample]
        for i in range(len(dim)):
            rows = parts[i]
            if len(rows):
                dim[i] = int(np.argmax(rows.max(0) - rows.min(0)))
                value[i] = float(np.median(rows[:, dim[i]]))
            below = rows[:, dim[i]] < value[i]
            parts += [rows[below], rows[~below]]
        return cls(dim, value)

    def leaf(self, z: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), int)
        while len(self.dim) and at[0] < len(self.dim):
            at = 2 * at + 1 + (z[np.arange(len(z)), self.dim[at]] >= self.value[at])
        return at - len(self.dim)


def _splits(rows: DataFrame, dims: list[str], size: Callable[[int], int], n: int) -> tuple[Splits, int]:
    """Splits of n rows for leaves of a block's size, as many as the sample can tell apart, and that size."""
    # Drawn where the rows lie: SAMPLE rows reach the driver on average, not as many from each partition.
    drawn = rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed=0)
    found = drawn.select(*[F.col(d).cast("double").alias(d) for d in dims]).dropna().collect()
    sample = np.array([tuple(r) for r in found], float).reshape(-1, len(dims))
    depth = max(0, int(np.ceil(np.log2(max(1, min(n / size(n), LEAVES, len(sample) / 8))))))
    return Splits.of(sample, depth), size(n)


def _values(column: pa.Array) -> np.ndarray:
    rows = column.flatten()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _blocks(
    df: DataFrame, dims: list[str], columns: list[str], size: Callable[[int], int], more: str | None = None, n: int | None = None
) -> DataFrame:
    """Rows (leaf, part, rows, lo, hi) of about so many rows as ``size`` gives for their number; a leaf with more of them has more parts.

    ``more`` names an array of doubles that stands behind the columns.
    """
    tree, most = _splits(df, dims, size, df.count() if n is None else n)
    names = [*columns, *([more] if more else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(dims))])
            if len(z):
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(z), pa.int32()), *batch.columns], ["leaf", *names])

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *names[len(columns) :]).dropna(subset=dims)
    kinds = [f"{c} double" for c in columns] + [f"{c} array<double>" for c in names[len(columns) :]]
    placed = doubles.mapInArrow(place, "leaf int, " + ", ".join(kinds))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    part = F.pmod(F.xxhash64(*columns), F.col("_parts"))
    row = F.concat(F.array(*columns), F.col(more)) if more else F.array(*columns)
    return placed.join(F.broadcast(sizes), "leaf").groupBy("leaf", part.alias("part")).agg(  # LEAVES rows at most
        F.collect_list(row).alias("rows"),
        F.array(*[F.min(d) for d in dims]).alias("lo"), F.array(*[F.max(d) for d in dims]).alias("hi"),
    )


def _shares(tasks: int, blocks: int, most: int, points: int, sources: int) -> tuple[int, int]:
    """Groups of points and parts of the sources for each, about ``tasks`` in all, that copy least; points and sources in numbers.

    Every group has a copy of the sources, and every part one of the points and their sums, which are written once more. There are
    ``blocks`` of points to group and ``most`` of sources to deal.
    """
    least = min(blocks, ceil(points / HELD))
    whole = max(1, least, min(tasks, blocks))
    groups = max(1, least, min(whole, round(sqrt(tasks * 2 * points / max(1, sources)))))
    parts = max(1, min(most, round(tasks / groups)))
    if whole >= tasks and whole * sources <= groups * sources + 2 * parts * points:
        return whole, 1
    return groups, parts


def sums_in_reach(
    points: DataFrame, sources: DataFrame, dims: list[str], point_extras: list[str], source_extras: list[str],
    reach: float, function: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str,
    finish: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, width: int = 1, more: tuple[str, int] | None = None,
) -> DataFrame:
    """(point columns, sum) where ``function`` maps a block of points and one of sources to a sum per point.

    Points are taken once per distinct row. Those with nothing in reach have no row. A point may have several sums: ``function``
    gives a row of ``width`` of them, and ``finish`` maps a block of points and its sums to one row of doubles per point, kept as an
    array. ``more`` names an array of the sources and its length; its values stand behind the source columns.
    """
    pcols, scols, n = [*dims, *point_extras], [*dims, *source_extras], len(dims)
    across = len(scols) + (more[1] if more else 0)
    n_sources, most = sources.count(), max(BLOCK // 8, min(BLOCK, WIDEST // across))
    held = _blocks(sources, dims, scols, lambda _: most, more[0] if more else None, n_sources)
    # Read several times over: for their number, their splits and their blocks.
    spots = checkpointed(points.select(*pcols).distinct())
    n_points = spots.count()
    asked = _blocks(spots, dims, pcols, lambda k: min(max(BLOCK, k // TASKS), MOST), n=n_points)
    asked = checkpointed(asked.select((F.col("leaf") * F.lit(1 << 32) + F.col("part")).alias("_b"), "leaf", "part", "rows", "lo", "hi"))
    # The boxes, numbers of parts and of rows of the leaves: LEAVES rows at most, whatever the number of points.
    ends = [f(F.col(side)[i]).alias(f"{side}{i}") for f, side in ((F.min, "lo"), (F.max, "hi")) for i in range(n)]
    boxes = asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("blocks"), F.max("part").alias("last"), F.sum(F.size("rows")).alias("size"), *ends).collect()
    boxes.sort(key=lambda r: r["leaf"])
    leaves, last, size = (np.array([r[c] for r in boxes], np.int64) for c in ("leaf", "last", "size"))
    lo, hi = (np.array([[r[f"{side}{i}"] for i in range(n)] for r in boxes], float).reshape(-1, n) for side in ("lo", "hi"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = tasks * ceil(TASKS / tasks) if tasks < TASKS // 2 else tasks
    groups, parts = _shares(units, sum(r["blocks"] for r in boxes), ceil(n_sources / most), n_points * (len(pcols) + width), n_sources * across)
    before, total = np.cumsum(size) - size, max(1, int(size.sum()))

    def group(at: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Blocks in the order of their leaves, cut where as many rows lie before."""
        return ((before[at] + (part + 0.5) * size[at] / (last[at] + 1)) / total * groups).astype(np.int64)

    first, final = group(np.arange(len(leaves)), 0 * last), group(np.arange(len(leaves)), last)

    @F.pandas_udf("bigint")
    def own(leaf, part):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(group(np.searchsorted(leaves, leaf.to_numpy()), part.to_numpy()))

    @F.pandas_udf("array<bigint>")
    def near(slo, shi):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for a, b in zip(slo, shi):
            gap = np.maximum(0.0, np.maximum(lo - np.asarray(b), np.asarray(a) - hi))
            met = np.flatnonzero((gap**2).sum(1) <= reach**2)
            out.append(np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(first[i], final[i] + 1) for i in met]])))
        return pd.Series(out)

    def unit(rows: DataFrame, kind: int, number: Column) -> DataFrame:
        return rows.select((F.col("_g") * parts + F.col("_s")).cast("int").alias("_u"), F.lit(kind).alias("_k"), number.alias("_b"), "rows")

    # The points of a group, then the sources that it meets; sorted, so a task holds one group with its sums.
    mine = asked.withColumn("_g", own("leaf", "part")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = held.select(F.explode(near("lo", "hi")).alias("_g"), F.pmod(F.xxhash64("leaf", "part"), F.lit(parts)).alias("_s"), "rows")
    both = unit(mine, 0, F.col("_b")).unionByName(unit(met, 1, F.lit(-1).cast("long")))
    both = both.repartitionById(tasks, "_u").sortWithinPartitions("_u", "_k")

    def rows_of(block: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        values = sums if finish is None else finish(block, sums)
        kept = pa.array(values) if values.ndim == 1 else pa.array(list(values), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*[pa.array(block[:, c]) for c in range(len(pcols))], kept], [*pcols, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, blocks, ends = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            for number, block, sums in blocks:
                if sums is not None and parts == 1:
                    yield rows_of(block, sums)
                elif sums is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["_b", "_sums"])

        for batch in batches:
            places, kinds, numbers, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            for at, kind in enumerate(kinds):
                values = _values(rows.slice(at, 1))
                if places[at] != unit:
                    yield from done()
                    unit, blocks, ends = places[at], [], None
                if kind == 0:
                    blocks.append([numbers[at], values.copy(), None])
                    continue
                if not blocks:
                    continue
                if ends is None:
                    ends = [np.array([f(b[:, :n], axis=0) for _, b, _ in blocks]) for f in (np.min, np.max)]
                low, high = values[:, :n].min(axis=0), values[:, :n].max(axis=0)
                gap = np.maximum(0.0, np.maximum(ends[0] - high, low - ends[1]))
                for i in np.flatnonzero((gap**2).sum(1) <= reach**2):
                    block = blocks[i][1]
                    for k in range(0, len(values), BLOCK):
                        some = values[k : k + BLOCK]
                        sums = np.concatenate([function(block[j : j + BLOCK], some) for j in range(0, len(block), BLOCK)])
                        blocks[i][2] = sums if blocks[i][2] is None else blocks[i][2] + sums
        yield from done()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, None
        for batch in batches:
            kinds, rows, some = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for at, kind in enumerate(kinds):
                if kind == 0:
                    if sums is not None:
                        yield rows_of(block, sums)
                    block, sums = _values(rows.slice(at, 1)), None
                    continue
                own = np.frombuffer(some[at].as_buffer()).reshape(len(block) if finish is None else (len(block), -1))
                sums = own.copy() if sums is None else sums + own
        if sums is not None:
            yield rows_of(block, sums)

    schema = ", ".join([*[f"{c} double" for c in pcols], f"{name} {'double' if finish is None else 'array<double>'}"])
    if parts == 1:
        return both.select("_u", "_k", "_b", "rows").mapInArrow(run, schema)
    some = both.select("_u", "_k", "_b", "rows").mapInArrow(run, "_b long, _sums binary")
    once = asked.select("_b", F.lit(0).alias("_k"), "rows", F.lit(None).cast("binary").alias("_sums"))
    again = once.unionByName(some.select("_b", F.lit(1).alias("_k"), F.lit(None).cast("array<array<double>>").alias("rows"), "_sums"))
    return spread(again, "_b").sortWithinPartitions("_b", "_k").select("_k", "rows", "_sums").mapInArrow(added, schema)
