"""Evidence, design and acquisition queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from runlattice.operators import acquire, design, evidence_wide
from runlattice.operators import evidence as ev
from runlattice.plans.base import query, sql
from runlattice.plans.grids import DAYS, EVENTS
from runlattice.plans.modelling import NORMED, VIEWS, fitted
from runlattice.schema import Param
from runlattice.sources import tables as tb

SIGMA = 0.08
DIMS = ["z0", "z1"]
G = f"exp(-(({{a}}.z0 - {{b}}.z0) ** 2 + ({{a}}.z1 - {{b}}.z1) ** 2) / {2 * SIGMA**2!r})"


def gauss(a: str, b: str) -> str:
    return G.format(a=a, b=b)


def kernels(spark, folder):
    return tb.kernels(spark, folder)


def fit(spark, folder, **how):
    return ev.fit_evidence(kernels(spark, folder), DIMS, SIGMA, **how)


def _kernel_sql():
    best = ", ".join(f"coalesce(arg_max(u.value, u.seq) FILTER (u.param = '{e}'), 0.0) AS {e}" for e in EVENTS)
    return sql(
        f"""SELECT s.exp_code, CAST(s.step AS INTEGER) AS step, round(1.0 / s.l, 9) AS w, {best} FROM steps s LEFT JOIN ups u ON u.exp_code = s.exp_code
        AND (u.iterator_code IS NULL OR (u.iterator_code = s.code AND u.step_index <= s.step)) GROUP BY s.exp_code, s.step, s.l, s.code""",
        "ups",
        extra={
            "first": "SELECT exp_code, coalesce(step_index, 0) AS step, min(coalesce(iterator_code, '')) AS code FROM ups GROUP BY 1, 2",
            "steps": "SELECT *, count(*) OVER (PARTITION BY exp_code) AS l FROM first",
        },
    )


@query("i01_kernel_table", _kernel_sql())
def kernel_table(spark, folder):
    out = ev.kernel_table(tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS)
    return out.withColumn("w", F.round("w", 9))


@query(
    "i02_active_dims",
    sql(
        """SELECT dim FROM (SELECT 'z0' AS dim, stddev_pop(z0) AS s FROM kernels UNION ALL SELECT 'z1', stddev_pop(z1) FROM kernels
        UNION ALL SELECT 'w', stddev_pop(w) FROM kernels) WHERE s > 1e-8""",
        "kernels",
    ),
)
def active(spark, folder):
    kept = ev.active_dims(kernels(spark, folder), ["z0", "z1", "w"])
    return spark.createDataFrame([(d,) for d in kept], "dim string")


@query(
    "i03_latent_bounds",
    sql(
        """SELECT 'total' AS column, round((1000 - m) / (s + 1e-8), 6) AS lo, round((400000 - m) / (s + 1e-8), 6) AS hi FROM st
        UNION ALL SELECT 'quantity', -1e6, 1e6 UNION ALL SELECT 'other', 0.0, 1.0""",
        *VIEWS, extra=NORMED,
    ).replace("-1e6, 1e6", "CAST(-1e6 AS DOUBLE), CAST(1e6 AS DOUBLE)"),
)
def latent(spark, folder):
    stats = fitted(spark, folder, "total", "quantity")
    bounds = ev.latent_bounds(stats, {"total": (1000.0, 400000.0), "quantity": None, "other": (5.0, 6.0)})
    return spark.createDataFrame([(c, round(a, 6), round(b, 6)) for c, (a, b) in bounds.items()], "column string, lo double, hi double")


DENSITY = f"SELECT c.cand_id, sum(k.w * {gauss('c', 'k')}) AS d FROM cand c, kernels k GROUP BY 1"


@query("i04_density", sql("SELECT cand_id, round(d, 6) AS density FROM dens", "kernels", "cand", extra={"dens": DENSITY}))
def density(spark, folder):
    out = ev.with_density(tb.candidates(spark, folder), fit(spark, folder, marginal_weight=1.0))
    return out.select("cand_id", F.round("density", 6).alias("density"))


@query("i05_evidence", sql("SELECT cand_id, round(d / (1 + d), 6) AS evidence FROM dens", "kernels", "cand", extra={"dens": DENSITY}))
def evidence(spark, folder):
    out = ev.with_density(tb.candidates(spark, folder), fit(spark, folder, marginal_weight=1.0))
    return out.select("cand_id", F.round(ev.evidence(F.col("density")), 6).alias("evidence"))


S2 = repr(2 * SIGMA**2)
PROBES = {
    "pr": f"SELECT r * {SIGMA} AS p, exp(-r * r / 2) / sum(exp(-r * r / 2)) OVER () * {SIGMA} * sqrt(2 * pi()) AS q FROM (VALUES (-2.0::DOUBLE), (-1.0), (-0.5), (0.0), (0.5), (1.0), (2.0)) t(r)",
    "ax": "SELECT kernel_id, w, 0 AS d, z0 AS z FROM kernels UNION ALL SELECT kernel_id, w, 1, z1 FROM kernels",
    "ay": "SELECT row_number() OVER () AS id, * FROM (SELECT d, z + p AS y, w * q AS v FROM ax, pr) WHERE y >= 0 AND y <= 1",
    "ar": f"SELECT a.id, a.d, a.y, a.v, sum(k.w * exp(-((a.y - k.z) ** 2) / {S2})) AS rho FROM ay a JOIN ax k ON k.d = a.d GROUP BY ALL",
}
SHELL = {
    "off": f"""SELECT 0.0::DOUBLE AS o0, 0.0::DOUBLE AS o1, pi() * (0.25 * {SIGMA}) ** 2 AS ow UNION ALL
        SELECT r * {SIGMA} * cos(k * pi() / 4), r * {SIGMA} * sin(k * pi() / 4), 2 * pi() * r * {SIGMA} * gap * {SIGMA} * exp(-r * r / 2) / 8
        FROM (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (1.0, 0.75), (2.0, 1.0)) t(r, gap), range(8) u(k)""",
    "jy": "SELECT row_number() OVER () AS id, * FROM (SELECT z0 + o0 AS z0, z1 + o1 AS z1, w * ow AS v FROM kernels, off) WHERE z0 BETWEEN 0 AND 1 AND z1 BETWEEN 0 AND 1",
    "jr": f"SELECT a.id, a.z0, a.z1, a.v, sum(k.w * {gauss('a', 'k')}) AS rho FROM jy a, kernels k GROUP BY ALL",
}
MARGINAL = "(SELECT sum(v / (1 + rho)) / 2 FROM ar)"
JOINT = "(SELECT sum(v / (1 + rho)) FROM jr)"


def one(spark, name: str, value: float):
    return spark.createDataFrame([(round(value, 6),)], f"{name} double")


@query("i06_marginal_integral", sql(f"SELECT round({MARGINAL}, 6) AS integral", "kernels", extra=PROBES))
def marginal(spark, folder):
    return one(spark, "integral", fit(spark, folder, marginal_weight=1.0).marginal_integral())


@query("i07_joint_integral", sql(f"SELECT round({JOINT}, 6) AS integral", "kernels", extra=SHELL))
def joint(spark, folder):
    return one(spark, "integral", fit(spark, folder, marginal_weight=0.0).joint_integral())


WIDE = ["z0", "z1", "z2", "z3"]
WIDE_KERNELS = {
    "raw": "SELECT vec_id AS kernel_id, " + ", ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) AS v{d}" for d in range(4)) + " FROM embeddings",
    "wk": "SELECT kernel_id, 1.0::DOUBLE AS w, " + ", ".join(f"(v{d} - min(v{d}) OVER ()) / (max(v{d}) OVER () - min(v{d}) OVER ()) AS z{d}" for d in range(4)) + " FROM raw",
}


def far(a: str, b: str) -> str:
    return "exp(-(" + " + ".join(f"({a}.z{d} - {b}.z{d}) ** 2" for d in range(4)) + f") / {S2})"


@query(
    "i04_density_wide",
    sql(f"SELECT p.kernel_id, round(sum(k.w * {far('p', 'k')}), 6) AS density FROM wk p, wk k GROUP BY 1", extra=WIDE_KERNELS),
)
def density_wide(spark, folder):
    four = tb.kernels(spark, folder, 4)
    out = evidence_wide.density(four.select("kernel_id", *WIDE), four, WIDE, SIGMA)
    return out.select("kernel_id", F.round("density", 6).alias("density"))


@lru_cache(maxsize=1)
def wide_sql() -> str:
    offsets, weights = ev.shell_probes(4, SIGMA)
    rows = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in [*o, w]) + ")" for o, w in zip(offsets, weights))
    moved = ", ".join(f"z{d} + o{d} AS z{d}" for d in range(4))
    inside = " AND ".join(f"z{d} BETWEEN 0 AND 1" for d in range(4))
    return sql(
        f"""SELECT round(sum(v / (1 + rho)), 6) AS integral FROM (SELECT y.id, any_value(y.v) AS v, sum(k.w * {far('y', 'k')}) AS rho FROM wy y, wk k GROUP BY 1)""",
        extra={
            **WIDE_KERNELS,
            "wo": f"SELECT * FROM (VALUES {rows}) t(o0, o1, o2, o3, ow)",
            "wy": f"SELECT row_number() OVER () AS id, * FROM (SELECT {moved}, w * ow AS v FROM wk, wo) WHERE {inside}",
        },
    )


@query("i07_joint_integral_wide", wide_sql())
def joint_wide(spark, folder):
    out = evidence_wide.joint_integral(tb.kernels(spark, folder, 4), WIDE, SIGMA)
    return out.select(F.round("integral", 6).alias("integral"))


def any_extent(dims: int, sigma: float, bounds: tuple[float, float] | None, probes: str = "shell", moved: str = "z0") -> dict[str, str]:
    """Views of the integrals by brute force: kernels k, probes of each axis and all axes with their densities (aq, jq)."""
    zs = [f"z{d}" for d in range(dims)]
    offsets, weights = (ev.shell_probes if probes == "shell" else ev.cube_probes)(dims, sigma)
    rows = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in [*o, w]) + ")" for o, w in zip(offsets, weights))
    inside = " AND ".join(f"{z} BETWEEN {bounds[0]!r} AND {bounds[1]!r}" for z in zs) if bounds else "true"
    d2 = " + ".join(f"(y.{z} - k.{z}) ** 2" for z in zs)
    two = repr(2 * sigma**2)
    scaled = ", ".join(f"(v{d} - min(v{d}) OVER ()) / (max(v{d}) OVER () - min(v{d}) OVER ()) AS z{d}" for d in range(dims))
    return {
        "raw": "SELECT vec_id AS kernel_id, " + ", ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) AS v{d}" for d in range(dims)) + " FROM embeddings",
        "k": f"SELECT kernel_id, 1.0::DOUBLE AS w, {moved} AS z0{''.join(f', z{d}' for d in range(1, dims))} FROM (SELECT kernel_id, {scaled} FROM raw)",
        "off": f"SELECT * FROM (VALUES {rows}) t({', '.join(f'o{d}' for d in range(dims))}, ow)",
        "jy": f"SELECT row_number() OVER () AS id, * FROM (SELECT {', '.join(f'{z} + o{d} AS {z}' for d, z in enumerate(zs))}, w * ow AS v FROM k, off) WHERE {inside}",
        "jq": f"SELECT y.id, {', '.join(f'any_value(y.{z}) AS {z}' for z in zs)}, any_value(y.v) AS v, sum(k.w * exp(-({d2}) / {two})) AS rho FROM jy y, k GROUP BY 1",
        "pr": f"SELECT r * {sigma} AS p, exp(-r * r / 2) / sum(exp(-r * r / 2)) OVER () * {sigma} * sqrt(2 * pi()) AS q FROM (VALUES (-2.0::DOUBLE), (-1.0), (-0.5), (0.0), (0.5), (1.0), (2.0)) t(r)",
        "ax": " UNION ALL ".join(f"SELECT {d} AS d, {z} AS z, w FROM k" for d, z in enumerate(zs)),
        "ay": "SELECT row_number() OVER () AS id, * FROM (SELECT d, z + p AS y, w * q AS v FROM ax, pr)" + (f" WHERE y BETWEEN {bounds[0]!r} AND {bounds[1]!r}" if bounds else ""),
        "aq": f"SELECT y.id, any_value(y.d) AS d, any_value(y.y) AS y, any_value(y.v) AS v, sum(k.w * exp(-((y.y - k.z) ** 2) / {two})) AS rho FROM ay y JOIN ax k ON k.d = y.d GROUP BY 1",
        "axis": f"SELECT sum(v / (1 + rho)) / {dims} AS i FROM aq", "joint": "SELECT sum(v / (1 + rho)) AS i FROM jq",
    }


def blend(dims: int) -> str:
    return f"SELECT round(({dims} * axis.i + joint.i) / {dims + 1}, 6) AS integral FROM axis, joint"


FAR_OFF = "CASE WHEN z0 = 1 THEN 40000.0 WHEN z0 = 0 THEN -7e8 ELSE z0 END"


def rounded(df):
    return df.select(F.round("integral", 6).alias("integral"))


@query("i08_integral_no_bounds", sql(blend(2), extra=any_extent(2, SIGMA, (-1e6, 1e6))))
def no_bounds(spark, folder):
    return rounded(evidence_wide.integral(kernels(spark, folder), DIMS, SIGMA, bounds=[(-1e6, 1e6)] * 2))


@query("i08_integral_outliers", sql(blend(2), extra=any_extent(2, SIGMA, (-1e9, 1e9), moved=FAR_OFF)))
def outliers(spark, folder):
    moved = kernels(spark, folder).withColumn("z0", F.expr(FAR_OFF))
    return rounded(evidence_wide.integral(moved, DIMS, SIGMA, bounds=[(-1e9, 1e9)] * 2))


@query("i07_joint_integral_narrow", sql("SELECT round(i, 6) AS integral FROM joint", extra=any_extent(3, 0.03, (0.0, 1.0))))
def narrow(spark, folder):
    return rounded(evidence_wide.joint_integral(tb.kernels(spark, folder, 3), WIDE[:3], 0.03))


@query("i09_cube_integral_wide", sql("SELECT round(i, 6) AS integral FROM joint", extra=any_extent(4, SIGMA, (0.0, 1.0), "cube")))
def cube_wide(spark, folder):
    return rounded(evidence_wide.joint_integral(tb.kernels(spark, folder, 4), WIDE, SIGMA, estimator="cube"))


WIDE_GAIN = {
    **any_extent(4, SIGMA, (0.0, 1.0)),
    "c": """SELECT s_suppkey AS cand_id, (s_acctbal + 1000.0) / 11000.0 AS z0, s_nationkey / 24.0 AS z1, s_suppkey % 10 / 9.0 AS z2, s_suppkey % 7 / 6.0 AS z3 FROM supplier""",
    "cx": " UNION ALL ".join(f"SELECT cand_id, {d} AS d, CAST(z{d} AS DOUBLE) AS z FROM c" for d in range(4)),
    "co": "SELECT cand_id, d, z, z + p AS y, q FROM cx, pr WHERE z + p BETWEEN 0 AND 1",
    "cm": f"""SELECT cand_id, sum(q / (1 + rho + exp(-((y - z) ** 2) / {S2}))) AS own FROM
        (SELECT c.cand_id, c.d, c.z, c.y, c.q, sum(k.w * exp(-((c.y - k.z) ** 2) / {S2})) AS rho FROM co c JOIN ax k ON k.d = c.d GROUP BY ALL) GROUP BY 1""",
    "cc": f"SELECT c.cand_id, sum(a.v / (1 + a.rho + exp(-((a.y - c.z) ** 2) / {S2})) - a.v / (1 + a.rho)) AS lost FROM cx c JOIN aq a ON a.d = c.d GROUP BY 1",
    "jo": f"""SELECT cand_id, ow, {', '.join(f'z{d} AS c{d}, z{d} + o{d} AS z{d}' for d in range(4))} FROM c, off WHERE {' AND '.join(f'c.z{d} + o{d} BETWEEN 0 AND 1' for d in range(4))}""",
    "jp": f"SELECT y.*, (SELECT sum(k.w * exp(-({' + '.join(f'(y.z{d} - k.z{d}) ** 2' for d in range(4))}) / {S2})) FROM k) AS rho FROM jo y",
    "jm": f"SELECT cand_id, sum(ow / (1 + rho + exp(-({' + '.join(f'(z{d} - c{d}) ** 2' for d in range(4))}) / {S2}))) AS own FROM jp GROUP BY 1",
    "jc": f"""SELECT c.cand_id, sum(a.v / (1 + a.rho + exp(-({' + '.join(f'(a.z{d} - c.z{d}) ** 2' for d in range(4))}) / {S2})) - a.v / (1 + a.rho)) AS lost FROM c, jq a GROUP BY 1""",
}


@query(
    "i10_gain_wide",
    sql(
        """SELECT cand_id, round((coalesce(cm.own, 0) + cc.lost) / 5 + (coalesce(jm.own, 0) + jc.lost) / 5, 6) AS gain
        FROM c LEFT JOIN cm USING (cand_id) JOIN cc USING (cand_id) LEFT JOIN jm USING (cand_id) JOIN jc USING (cand_id)""",
        extra=WIDE_GAIN,
    ),
)
def gain_wide(spark, folder):
    plus = [((F.col("cand_id") % m) / (m - 1.0)).alias(z) for m, z in ((10, "z2"), (7, "z3"))]
    spots = tb.candidates(spark, folder).select("*", *plus)
    return evidence_wide.gain(spots, tb.kernels(spark, folder, 4), WIDE, SIGMA).select("cand_id", F.round("gain", 6).alias("gain"))


@query("i08_blended_integral", sql(f"SELECT round(2 * {MARGINAL} / 3 + {JOINT} / 3, 6) AS integral", "kernels", extra={**PROBES, **SHELL}))
def blended(spark, folder):
    return one(spark, "integral", fit(spark, folder).integral())


@lru_cache(maxsize=1)
def cube_sql() -> str:
    offsets, weights = ev.cube_probes(2, SIGMA)
    rows = ", ".join(f"({float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for (a, b), w in zip(offsets, weights))
    return sql(f"SELECT round({JOINT}, 6) AS integral", "kernels", extra={**SHELL, "off": f"SELECT * FROM (VALUES {rows}) t(o0, o1, ow)"})


@query("i09_cube_integral", cube_sql())
def cube(spark, folder):
    return one(spark, "integral", fit(spark, folder, estimator="cube").integral())


GAIN = {
    **PROBES,
    **SHELL,
    "cx": "SELECT cand_id, 0 AS d, z0 AS z FROM cand UNION ALL SELECT cand_id, 1, z1 FROM cand",
    "co": "SELECT cand_id, d, z, z + p AS y, q FROM cx, pr WHERE z + p BETWEEN 0 AND 1",
    "cm": f"""SELECT cand_id, sum(q / (1 + rho + exp(-((y - z) ** 2) / {S2}))) AS own FROM
        (SELECT c.cand_id, c.d, c.z, c.y, c.q, sum(k.w * exp(-((c.y - k.z) ** 2) / {S2})) AS rho FROM co c JOIN ax k ON k.d = c.d GROUP BY ALL) GROUP BY 1""",
    "cc": f"""SELECT c.cand_id, sum(a.v / (1 + a.rho + exp(-((a.y - c.z) ** 2) / {S2})) - a.v / (1 + a.rho)) AS lost FROM cx c JOIN ar a ON a.d = c.d GROUP BY 1""",
    "jo": "SELECT cand_id, c.z0 AS c0, c.z1 AS c1, c.z0 + o0 AS z0, c.z1 + o1 AS z1, ow FROM cand c, off WHERE c.z0 + o0 BETWEEN 0 AND 1 AND c.z1 + o1 BETWEEN 0 AND 1",
    "jm": f"""SELECT cand_id, sum(ow / (1 + rho + exp(-((z0 - c0) ** 2 + (z1 - c1) ** 2) / {S2}))) AS own FROM
        (SELECT j.*, (SELECT sum(k.w * {gauss('j', 'k')}) FROM kernels k) AS rho FROM jo j) GROUP BY 1""",
    "jc": f"SELECT c.cand_id, sum(a.v / (1 + a.rho + {gauss('a', 'c')}) - a.v / (1 + a.rho)) AS lost FROM cand c, jr a GROUP BY 1",
    "gain": """SELECT cand_id, 2 * (cm.own + cc.lost) / 2 / 3 + (jm.own + jc.lost) / 3 AS gain FROM cm JOIN cc USING (cand_id) JOIN jm USING (cand_id) JOIN jc USING (cand_id)""",
}


@query("i10_gain", sql("SELECT cand_id, round(gain, 6) AS gain FROM gain", "kernels", "cand", extra=GAIN))
def gain(spark, folder):
    out = ev.with_gain(tb.candidates(spark, folder), fit(spark, folder))
    return out.select("cand_id", F.round("gain", 6).alias("gain"))


@query(
    "i11_model_average",
    sql(
        f"""SELECT cand_id, round(sum(mw * d) / sum(mw), 6) AS density FROM (SELECT c.cand_id, k.model, k.model + 1.0 AS mw,
        sum(k.w * {gauss('c', 'k')}) AS d FROM cand c, kernels k GROUP BY ALL) GROUP BY 1""",
        "kernels", "cand",
    ),
)
def model_average(spark, folder):
    models = fit(spark, folder, by="model", marginal_weight=1.0)
    out = ev.with_density(tb.candidates(spark, folder), models, {m: m + 1.0 for m in models})
    return out.select("cand_id", F.round("density", 6).alias("density"))


@query(
    "i12_virtual_points",
    sql(
        f"""SELECT p.kernel_id, round(sum(v.w * {gauss('p', 'v')}), 6) AS density FROM kernels p,
        (SELECT z0, z1, w FROM kernels UNION ALL SELECT z0, z1, 0.5 FROM cand) v GROUP BY 1""",
        "kernels", "cand",
    ),
)
def virtual(spark, folder):
    pending = tb.candidates(spark, folder).select("z0", "z1", F.lit(0.5).alias("w"))
    both = ev.with_virtual(kernels(spark, folder), pending)
    out = ev.with_density(ev.without_virtual(both.where("NOT is_virtual")), ev.fit_evidence(both, DIMS, SIGMA, marginal_weight=1.0))
    return out.select("kernel_id", F.round("density", 6).alias("density"))


@query("i13_in_bounds", sql("SELECT cand_id, z0 >= 0.1 AND z0 <= 0.9 AND z1 >= 0 AND z1 <= 0.5 AS inside FROM cand", "cand"))
def bounds_mask(spark, folder):
    inside = ev.in_bounds(DIMS, [(0.1, 0.9), (0.0, 0.5)])
    return tb.candidates(spark, folder).select("cand_id", inside.alias("inside"))


GRID_POINTS = "SELECT CAST(x.i AS INTEGER) AS ix, CAST(y.i AS INTEGER) AS iy, x.i / 11.0 AS z0, y.i / 7.0 AS z1 FROM range(12) x(i), range(8) y(i)"


def grid_points(spark):
    return design.sweep(spark.range(1), ("z0", 0.0, 1.0, 12), ("z1", 0.0, 1.0, 8))


@query(
    "i14_evidence_grid",
    sql(f"SELECT ix, iy, round(sum(k.w * {gauss('g', 'k')}) / (1 + sum(k.w * {gauss('g', 'k')})), 6) AS evidence FROM gp g, kernels k GROUP BY 1, 2", "kernels", extra={"gp": GRID_POINTS}),
)
def evidence_grid(spark, folder):
    out = ev.with_density(grid_points(spark), fit(spark, folder, marginal_weight=1.0))
    return out.select("ix", "iy", F.round(ev.evidence(F.col("density")), 6).alias("evidence"))


def sobol_sql(index: str, dim: int, seed: int) -> str:
    """One coordinate of the sequence at an index, from its direction numbers."""
    gray = f"xor({index}, {index} >> 1)"
    expr = f"CAST({design.digital_shift(dim, seed)} AS BIGINT)"
    for bit, v in enumerate(design.direction_numbers(dim)):
        expr = f"xor({expr}, (({gray} >> {bit}) & 1) * {v})"
    return f"({expr} + 0.5::DOUBLE) / 1073741824.0"


@query(
    "j01_sobol_points",
    "SELECT o_orderkey AS exp_code, " + ", ".join(f"{sobol_sql('o_orderkey', d, 3)} AS u{d}" for d in range(3)) + " FROM orders",
)
def sobol_points(spark, folder):
    return design.unit_points(tb.experiments(spark, folder).select("exp_code"), "exp_code", ["u0", "u1", "u2"], seed=3)


NUMBERS = [Param("speed", "real", 5.0, 205.0), Param("count", "int", 1, 9)]


@query(
    "j02_to_real",
    """SELECT o_orderkey AS exp_code, round(o_totalprice / 500000.0 * 200 + 5, 6) AS speed,
       CAST(greatest(1, least(9, round_even(o_totalprice / 500000.0 * 8, 0) + 1)) AS BIGINT) AS count FROM orders""",
)
def to_real(spark, folder):
    u = F.col("total") / 500000.0
    return tb.experiments(spark, folder).select(
        "exp_code", F.round(design.to_real(u, NUMBERS[0]), 6).alias("speed"), design.to_real(u, NUMBERS[1]).alias("count")
    )


LABELS = [Param("status", "category", vocab=tb.STATUSES), Param("priority", "category", vocab=tb.PRIORITIES[:3])]


@query(
    "j03_strata",
    """SELECT cand_id, CAST(CASE WHEN cand_id < edge THEN cand_id // (each + 1) ELSE extra + (cand_id - edge) // each END AS BIGINT) AS stratum,
       list_extract(['F', 'O', 'P'], 1 + (CASE WHEN cand_id < edge THEN cand_id // (each + 1) ELSE extra + (cand_id - edge) // each END) // 3) AS status
       FROM (SELECT c_custkey AS cand_id, n // 9 AS each, n % 9 AS extra, (n % 9) * (n // 9 + 1) AS edge
       FROM customer, (SELECT count(*) AS n FROM customer))""",
)
def strata(spark, folder):
    rows = tb.table(spark, folder, "customer").select(F.col("c_custkey").alias("cand_id"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return design.assign_strata(rows, "cand_id", n, LABELS).select("cand_id", "stratum", "status")


@query(
    "j04_sobol_design",
    f"""SELECT cand_id, CAST(round_even(u0 * 200 + 5, 3) AS DOUBLE) AS speed, CAST(greatest(1, least(9, round_even(u1 * 8, 0) + 1)) AS BIGINT) AS count,
       list_extract(['F', 'O', 'P'], 1 + CASE WHEN cand_id < edge THEN cand_id // (each + 1) ELSE extra + (cand_id - edge) // each END) AS status,
       '2-HIGH' AS priority, CAST(ceil((u0 * 200 + 5) / 50) AS INTEGER) AS n_layers,
       '{{"source":"sobol_step","seed":0,"design":"sobol"}}' AS config_snapshot
       FROM (SELECT c_custkey AS cand_id, n // 3 AS each, n % 3 AS extra, (n % 3) * (n // 3 + 1) AS edge, {sobol_sql('c_custkey', 0, 0)} AS u0,
       {sobol_sql('c_custkey', 1, 0)} AS u1 FROM customer, (SELECT count(*) AS n FROM customer))""",
)
def sobol_design(spark, folder):
    rows = tb.table(spark, folder, "customer").select(F.col("c_custkey").alias("cand_id"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return design.sobol_design(
        rows, "cand_id", [*NUMBERS, *LABELS], n, fixed={"priority": "2-HIGH"}, derived={"n_layers": F.ceil(F.col("speed") / 50).cast("int")}
    )


@query(
    "j07_trust_region",
    """SELECT s_suppkey AS cand_id, greatest(0.0::DOUBLE, s_acctbal - 500) AS balance_lo, least(9000.0::DOUBLE, s_acctbal + 500) AS balance_hi,
       greatest(0.0::DOUBLE, s_nationkey) AS nation_lo, least(24.0::DOUBLE, s_nationkey) AS nation_hi FROM supplier""",
)
def trust(spark, folder):
    limits = design.global_bounds(
        [Param("balance", "real", -1000.0, 10000.0), Param("nation", "int", 0, 24)], configured={"balance": (0.0, 9000.0)}
    )
    rows = tb.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cand_id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation")
    )
    return design.trust_region(rows, {"balance": 500.0}, limits).drop("balance", "nation")


@query(
    "j08_sweep",
    """SELECT s_suppkey AS cand_id, CAST(x.i AS INTEGER) AS ix, CAST(y.i AS INTEGER) AS iy, round(s_acctbal + 100.0 * x.i / 4.0, 6) AS balance,
       y.i / 2.0 AS share, 'B' AS kind, round((s_acctbal + 100.0 * x.i / 4.0) * (y.i / 2.0), 6) AS cost
       FROM supplier, range(5) x(i), range(3) y(i)""",
)
def sweep(spark, folder):
    rows = tb.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("cand_id"), F.col("s_acctbal").alias("b"))
    out = design.sweep(
        rows, ("balance", F.col("b"), F.col("b") + 100.0, 5), ("share", 0.0, 1.0, 3), {"kind": "B"}, {"cost": F.col("balance") * F.col("share")}
    )
    return out.drop("b").withColumns({"balance": F.round("balance", 6), "cost": F.round("cost", 6)})




def perf():
    """Expected performance of a candidate: a formula model scored to [0, 1]."""
    return 1 - F.abs(F.col("z0") - 0.5) * F.col("z1")


SCORE = {**GAIN, "acq": "SELECT cand_id, 0.75 * (1 - abs(z0 - 0.5) * z1) + 0.25 * gain AS score FROM cand JOIN gain USING (cand_id)"}


@query("j09_acquisition", sql("SELECT cand_id, round(score, 6) AS score FROM acq", "kernels", "cand", extra=SCORE))
def acquisition(spark, folder):
    out = acquire.acquisition(tb.candidates(spark, folder), 0.25, perf(), fit(spark, folder))
    return out.select("cand_id", F.round("score", 6).alias("score"))


GRID_GAIN = {**GAIN, "cand": f"SELECT ix * 8 + iy AS cand_id, ix, iy, z0, z1 FROM ({GRID_POINTS})"}


def _grid_sql():
    extra = {"cand": GRID_GAIN["cand"], **{k: v for k, v in GAIN.items()}}
    return sql(
        "SELECT ix, iy, round(0.5 * (1 - abs(z0 - 0.5) * z1) + 0.5 * gain, 6) AS score FROM cand JOIN gain USING (cand_id)",
        "kernels", extra=extra,
    )


@query("j10_acquisition_grid", _grid_sql())
def acquisition_grid(spark, folder):
    out = acquire.acquisition(grid_points(spark), 0.5, perf(), fit(spark, folder))
    return out.select("ix", "iy", F.round("score", 6).alias("score"))


@query("j11_best", sql("SELECT cand_id, round(score, 6) AS score FROM acq ORDER BY acq.score DESC, cand_id LIMIT 10", "kernels", "cand", extra=SCORE))
def top(spark, folder):
    scored = acquire.acquisition(tb.candidates(spark, folder), 0.25, perf(), fit(spark, folder))
    return acquire.best(scored, 10).select("cand_id", F.round("score", 6).alias("score"))


@query("j11_refined")
def refined(spark, folder):
    fitted_ = fit(spark, folder)
    first = acquire.best(acquire.acquisition(tb.candidates(spark, folder), 0.5, perf(), fitted_), 4)
    return acquire.best(acquire.acquisition(acquire.refine(first, DIMS, 32, 0.1), 0.5, perf(), fitted_), 4)


@query("j12_discover")
def discover(spark, folder):
    return acquire.discover(tb.candidates(spark, folder), fit(spark, folder), 3)


@query(
    "j13_propose",
    sql(
        """SELECT cand_id, round(0.5 * (1 - abs(z0 - 0.5) * z1) + 0.5 * gain, 6) AS score, 'exploration_step' AS source,
        '{"source":"exploration_step","kappa":0.5,"seed":7}' AS config_snapshot FROM cand JOIN gain USING (cand_id)
        ORDER BY 0.5 * (1 - abs(z0 - 0.5) * z1) + 0.5 * gain DESC, cand_id LIMIT 1""",
        "kernels", "cand", extra=GAIN,
    ),
)
def propose(spark, folder):
    out = acquire.propose(tb.candidates(spark, folder), None, perf(), fit(spark, folder), seed=7)
    return out.select("cand_id", F.round("score", 6).alias("score"), "source", "config_snapshot")


@query(
    "j14_trajectory",
    """SELECT cand_id, CAST(k AS INTEGER) AS step, round(1 / (1 + exp(-3 * (mid + (k - l // 2) * (1.6 / (1 + exp(-3 * slope)) - 0.8)))), 6) AS speed,
       round(1.0 / l, 9) AS weight FROM (SELECT s_suppkey AS cand_id, s_acctbal / 10000.0 AS mid, s_nationkey / 24.0 - 0.5 AS slope, 1 + s_nationkey % 5 AS l FROM supplier),
       unnest(range(l)) u(k)""",
)
def trajectory(spark, folder):
    rows = tb.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cand_id"), (F.col("s_acctbal") / 10000.0).alias("mid"), (F.col("s_nationkey") / 24.0 - 0.5).alias("slope"),
        (1 + F.col("s_nationkey") % 5).alias("l"),
    )
    out = design.trajectory_layers(rows, F.col("l"), {"speed": (F.col("mid"), F.col("slope"))})
    return out.select("cand_id", "step", F.round("speed", 6).alias("speed"), F.round("weight", 9).alias("weight"))


@query("j15_candidate_weight", "SELECT s_suppkey AS cand_id, round(1.0 / (1 + s_nationkey % 5), 9) AS weight FROM supplier")
def weight(spark, folder):
    rows = tb.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("cand_id"), (1 + F.col("s_nationkey") % 5).alias("l"))
    layers = design.trajectory_layers(rows, F.col("l"), {})
    return layers.groupBy("cand_id").agg(F.round(F.max("weight"), 9).alias("weight"))


@query(
    "j16_snapshot",
    """SELECT s_suppkey AS cand_id, '{"source":"exploration_step","kappa":0.25,"seed":' || s_suppkey || ',"radius":0.08}' AS config_snapshot FROM supplier""",
)
def snapshots(spark, folder):
    snap = design.snapshot("exploration_step", kappa=0.25, seed=F.col("cand_id"), radius=SIGMA)
    return tb.candidates(spark, folder).select("cand_id", snap.alias("config_snapshot"))


@query(
    "j17_derived",
    sql("SELECT exp_code, CAST(CASE WHEN n_layers > 0 THEN n_layers ELSE ceil(total / 100000) END AS INTEGER) AS n_layers, round(total / 2, 6) AS half FROM sized", "sized"),
)
def derived(spark, folder):
    rows = tb.sized_experiments(spark, folder).withColumn("n_layers", F.when(F.col("n_layers") > 0, F.col("n_layers")))
    out = design.derive(rows, {"n_layers": F.ceil(F.col("total") / 100000).cast("int"), "half": F.round(F.col("total") / 2, 6)})
    return out.select("exp_code", "n_layers", "half")


@query(
    "j18_defaults",
    sql(
        """SELECT exp_code, coalesce(CASE WHEN total > 300000 THEN NULL ELSE total END, 200500.0::DOUBLE) AS total, 'F' AS status,
        CAST(5 AS BIGINT) AS count, round(m, 4) AS flow FROM experiments, st""",
        *VIEWS, extra=NORMED,
    ),
)
def defaults(spark, folder):
    mean = fitted(spark, folder, "total")["total"].mean
    rows = tb.experiments(spark, folder).select("exp_code", F.when(F.col("total") <= 300000, F.col("total")).alias("total"))
    spec = [Param("total", lo=1000.0, hi=400000.0), Param("status", "category", vocab=tb.STATUSES), Param("count", "int", 1, 9), Param("flow")]
    out = design.fill_defaults(rows, spec, {"status": "F"}, {"flow": mean})
    return out.withColumn("flow", F.round("flow", 4))


