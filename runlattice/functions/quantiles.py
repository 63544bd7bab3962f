"""Exact order statistics without sorting a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def order_statistics(values: DataFrame, ranks: dict[str, list[int]], ends: dict[str, tuple[float, float]]):
    """The value at each 0-based rank of each named column.

    ``values`` has columns (name, value) without NULLs and ``ends`` each column's min and max.
    Every round counts one bounded histogram per open interval and narrows the interval to the
    observed ends of the bin that holds the rank; it is done when the bin holds one value.
    """
    spark = values.sparkSession
    found: dict[tuple[str, int], float] = {}
    pending: dict[tuple[str, int], tuple[float, float, int]] = {}
    for name, wanted in ranks.items():
        for rank in wanted:
            pending[(name, rank)] = (*ends[name], 0)
    while pending:
        for target, (lo, hi, _) in list(pending.items()):
            if lo == hi:
                found[target] = lo
                del pending[target]
        if not pending:
            break
        spans = sorted({(n, lo, hi) for (n, _), (lo, hi, _) in pending.items()})
        table = spark.createDataFrame(spans, "name string, lo double, hi double")
        # Halves: the difference of the ends of a column may be too large for a double.
        spot = F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)
        counted = (
            values.join(F.broadcast(table), "name")
            .where(F.col("value").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", F.least(spot, F.lit(BINS - 1)))
            .groupBy("name", "lo", "hi", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
            .collect()
        )
        bins: dict[tuple, list] = {}
        for row in sorted(counted, key=lambda r: r["bin"]):
            bins.setdefault((row["name"], row["lo"], row["hi"]), []).append(row)
        for target, (lo, hi, below) in list(pending.items()):
            seen = below
            for row in bins[(target[0], lo, hi)]:
                if target[1] < seen + row["n"]:
                    pending[target] = (row["a"], row["b"], seen)
                    break
                seen += row["n"]
    return found


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], lower: list[float] = ()):
    """Linear-interpolated quantiles ``probs`` and lower (actual value) quantiles ``lower``.

    Returns {column: {"n", "min", "max", ("q", p): value, ("low", p): value}}; a column without
    values maps to None. NULL, NaN and infinities are ignored.
    """
    finite = {c: F.abs(F.col(c).cast("double")) < float("inf") for c in columns}
    clean = df.select(*[F.when(finite[c], F.col(c).cast("double")).alias(c) for c in columns])
    if df.is_cached:
        return _quantiles(clean, columns, probs, lower)
    # Every round scans the values again; they are kept (with their lineage) in between.
    clean = clean.persist()
    try:
        return _quantiles(clean, columns, probs, lower)
    finally:
        clean.unpersist()


def _quantiles(clean: DataFrame, columns: list[str], probs: list[float], lower: list[float]) -> dict:
    head = clean.agg(
        *[f(c).alias(f"{c}\u0001{k}") for c in columns for k, f in (("n", F.count), ("min", F.min), ("max", F.max))]
    ).first()
    out: dict[str, dict | None] = {}
    ranks, ends = {}, {}
    for c in columns:
        n = head[f"{c}\u0001n"]
        if n == 0:
            out[c] = None
            continue
        out[c] = {"n": n, "min": head[f"{c}\u0001min"], "max": head[f"{c}\u0001max"]}
        ends[c] = (out[c]["min"], out[c]["max"])
        need = set()
        for p in probs:
            need |= {int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1)}
        for p in lower:
            need.add(int((n - 1) * p))
        ranks[c] = sorted(need)
    if not ranks:
        return out
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ranks]))
    long = clean.select(pairs.alias("p")).select("p.name", "p.value").where("value IS NOT NULL")
    stats = order_statistics(long, ranks, ends)
    for c in ranks:
        n = out[c]["n"]
        for p in probs:
            at = (n - 1) * p
            a, b = stats[(c, int(at))], stats[(c, min(int(at) + 1, n - 1))]
            out[c][("q", p)] = a + (b - a) * (at - int(at))
        for p in lower:
            out[c][("low", p)] = stats[(c, int((n - 1) * p))]
    return out
