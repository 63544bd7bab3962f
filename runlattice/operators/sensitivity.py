"""Which inputs drive a model's outputs: variance-based and elementary-effect indices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-12
# Two-sided 95 % normal quantile, cumulative Poisson(1) probabilities.
Z95 = 1.959963984540054
POISSON1 = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def hashed_unit(index: str, salt: str) -> Column:
    """Reproducible uniform number of a row, from the digest of salt and index."""
    text = F.concat(F.lit(f"{salt}:"), F.col(index).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / float(16**7)


def saltelli(df: DataFrame, index: str, a: list[str], b: list[str], inputs: list[str]) -> DataFrame:
    """Blocks 0 … D+1 per base point: A, then A with one column of B each, then B."""
    d = len(inputs)
    blocks = df.select(index, *a, *b).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(d + 1))))
    swapped = {
        name: F.when((F.col("block") == j + 1) | (F.col("block") == d + 1), F.col(b[j])).otherwise(F.col(a[j]))
        for j, name in enumerate(inputs)
    }
    return blocks.withColumns(swapped).select(index, "block", *inputs)


def evaluate(design: DataFrame, outputs: dict[str, Column], fixed: dict | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Outputs at each design point; a missing output is an error."""
    df = design.withColumns({c: F.lit(v) for c, v in (fixed or {}).items()})
    df = df.withColumns({c: e for c, e in (derived or {}).items() if c not in df.columns})
    return df.withColumns(
        {
            n: F.when(e.isNotNull(), e.cast("double")).otherwise(
                F.raise_error(F.lit(f"no value for output {n}")).cast("double")
            )
            for n, e in outputs.items()
        }
    )


def _long(evaluated: DataFrame, keep: list[str], outputs: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("y")) for o in outputs]))
    return evaluated.select(*keep, pairs.alias("p")).select(*keep, "p.output", "p.y")


def flat_outputs(evaluated: DataFrame, outputs: list[str]) -> list[str]:
    """Outputs that hardly vary; their indices are undefined."""
    row = evaluated.agg(*[F.stddev_pop(o).alias(o) for o in outputs]).first()
    return [o for o in outputs if row[o] is None or row[o] < FLAT]


def sobol_indices(
    evaluated: DataFrame, index: str, inputs: list[str], outputs: list[str], replicates: int = 0
) -> DataFrame:
    """(output, input, s1, st, s1_conf, st_conf).

    First-order indices by Saltelli's 2010 estimator, total ones by Jansen's. Confidence is
    1.96 times the spread over replicates with Poisson weights. Outputs that hardly vary get 0.
    """
    d = len(inputs)
    row = evaluated.agg(*[f(o).alias(f"{n}_{o}") for o in outputs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    live = [o for o in outputs if row[f"s_{o}"] is not None and row[f"s_{o}"] >= FLAT]
    scaled = evaluated.withColumns({o: (F.col(o) - row[f"m_{o}"]) / row[f"s_{o}"] for o in live})
    spark = evaluated.sparkSession
    zeros = [(o, i, 0.0, 0.0, 0.0, 0.0) for o in outputs if o not in live for i in inputs]
    none = spark.createDataFrame(zeros, "output string, input string, s1 double, st double, s1_conf double, st_conf double")
    if not live:
        return none
    wide = _long(scaled, [index, "block"], live).groupBy("output", index).agg(
        *[F.max(F.when(F.col("block") == j, F.col("y"))).alias(f"y{j}") for j in range(d + 2)]
    )

    def estimates(df: DataFrame, by: list[str], w: Column) -> DataFrame:
        ya, yb = F.col("y0"), F.col(f"y{d + 1}")
        total = F.sum(w)
        mean = F.sum(w * (ya + yb)) / (2 * total)
        var = F.sum(w * (ya * ya + yb * yb)) / (2 * total) - mean * mean
        parts = [
            F.struct(
                F.lit(name).alias("input"),
                (F.sum(w * yb * (F.col(f"y{j + 1}") - ya)) / total / var).alias("s1"),
                (F.sum(w * (ya - F.col(f"y{j + 1}")) ** 2) / total / 2 / var).alias("st"),
            )
            for j, name in enumerate(inputs)
        ]
        out = df.groupBy(*by).agg(F.array(*parts).alias("r"))
        return out.select(*by, F.explode("r").alias("r")).select(*by, "r.input", "r.s1", "r.st")

    point = estimates(wide, ["output"], F.lit(1.0))
    if replicates <= 1:
        out = point.withColumns({"s1_conf": F.lit(0.0), "st_conf": F.lit(0.0)})
    else:
        rep = wide.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        u = F.pmod(F.xxhash64("_r", index), F.lit(1 << 40)) / float(1 << 40)
        weight = reduce(lambda a, t: a + F.when(u >= t, 1.0).otherwise(0.0), POISSON1, F.lit(0.0))
        rep = estimates(rep.withColumn("_w", weight), ["output", "_r"], F.col("_w"))
        spread = rep.groupBy("output", "input").agg(
            (Z95 * F.stddev_samp("s1")).alias("s1_conf"), (Z95 * F.stddev_samp("st")).alias("st_conf")
        )
        out = point.join(F.broadcast(spread), ["output", "input"])
    return out.select(*none.columns).unionByName(none)


def morris_design(df: DataFrame, index: str, inputs: list[str], levels: int = 4, seed: int = 0) -> DataFrame:
    """One trajectory per row: D + 1 points on a grid, one input moved per step.

    Start levels and the order of the inputs come from the row's digest.
    """
    if levels % 2:
        raise ValueError("the number of levels must be even")
    jump = levels / 2 / (levels - 1)
    d = len(inputs)
    out = df.select(index)
    level = {n: F.floor(hashed_unit(index, f"{seed}/level/{n}") * levels) for n in inputs}
    out = out.withColumns({f"_g_{n}": c for n, c in level.items()})
    order = F.transform(
        F.array_sort(F.array(*[F.struct(hashed_unit(index, f"{seed}/order/{n}").alias("h"), F.lit(n).alias("n")) for n in inputs])),
        lambda s: s.n,
    )
    out = out.withColumn("_order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    sign = {n: F.when(F.col(f"_g_{n}") < levels / 2, 1.0).otherwise(-1.0) for n in inputs}
    values = {
        n: F.col(f"_g_{n}") / float(levels - 1)
        + F.when(F.array_position("_order", n) <= F.col("step"), sign[n] * jump).otherwise(0.0)
        for n in inputs
    }
    moved = F.get("_order", F.col("step") - 1)
    delta = reduce(lambda acc, n: acc.when(moved == n, sign[n] * jump), inputs, F.when(F.lit(False), 0.0))
    return out.withColumns({**values, "changed": moved, "delta": delta}).select(index, "step", *inputs, "changed", "delta")


def morris_indices(evaluated: DataFrame, index: str, outputs: list[str]) -> DataFrame:
    """(output, input, mu, mu_star, sigma) of the elementary effects.

    The window holds one trajectory, D + 1 points. Outputs that hardly vary get 0.
    """
    flat = flat_outputs(evaluated, outputs)
    w = Window.partitionBy(index, "output").orderBy("step")
    long = _long(evaluated, [index, "step", "changed", "delta"], outputs)
    effects = long.withColumn("ee", (F.col("y") - F.lag("y").over(w)) / F.col("delta")).where("step > 0")
    out = effects.groupBy("output", F.col("changed").alias("input")).agg(
        F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma")
    )
    zero = F.col("output").isin(*flat) if flat else F.lit(False)
    return out.withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in ("mu", "mu_star", "sigma")})


def top_k(indices: DataFrame, value: str = "st", k_inputs: int | None = None, k_outputs: int | None = None) -> DataFrame:
    """Keep the inputs with the greatest index over the outputs, then the outputs likewise."""

    def keep(df, what, k):
        # One row per declared name is ranked.
        best = df.groupBy(what).agg(F.max(value).alias("_v"))
        return df.join(F.broadcast(best.orderBy(F.col("_v").desc(), what).limit(k).select(what)), what, "left_semi")

    if k_inputs is not None:
        indices = keep(indices, "input", k_inputs)
    if k_outputs is not None:
        indices = keep(indices, "output", k_outputs)
    return indices
