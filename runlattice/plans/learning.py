"""Cross-validation, sensitivity, prediction and report queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlattice.operators import cv, grid, metrics, models, prep, report, sensitivity, sets
from runlattice.operators import evidence as ev
from runlattice.plans.base import query, sql
from runlattice.plans.catalog import MEMBERS, SPLIT, members, splits
from runlattice.plans.coverage import GRID_POINTS, fit, gauss, grid_points
from runlattice.plans.grids import DAYS, EVENTS
from runlattice.plans.modelling import PRED, R2, predictions
from runlattice.sources import tables as tb

INPUTS = ["quantity", "discount"]


def measured(spark, folder):
    return tb.cells(spark, folder).select("exp_code", "layer", "quantity", "discount", "price")


OLS = """avg(price) AS my, avg(quantity) AS m1, avg(discount) AS m2, covar_pop(price, quantity) AS c1, covar_pop(price, discount) AS c2,
    var_pop(quantity) AS v1, var_pop(discount) AS v2, covar_pop(quantity, discount) AS c12"""
FIT = "my + (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) * (quantity - m1) + (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) * (discount - m2)"
FOLDS = {
    "fold": "SELECT exp_code, (row_number() OVER (ORDER BY md5('3:' || exp_code)) - 1) % 5 AS fold FROM experiments",
    "held": "SELECT c.*, f.fold FROM cells c JOIN fold f USING (exp_code)",
    "ols": f"SELECT k AS fold, {OLS} FROM held, range(5) t(k) WHERE fold <> k GROUP BY 1",
    "cvp": f"SELECT exp_code, 'price' AS feature, price AS truth, {FIT} AS pred FROM held JOIN ols USING (fold)",
    "cve": """SELECT exp_code, feature, avg(abs(truth - pred)) AS mae, count(*) AS n_samples,
        CASE WHEN var_pop(truth) * count(*) < 1e-8 THEN CASE WHEN sum((truth - pred) ** 2) > 1e-8 THEN 0.0 ELSE 1.0 END
        ELSE 1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)) END AS r2 FROM cvp GROUP BY 1, 2""",
}


def errors(spark, folder):
    folds = sets.folds(tb.experiments(spark, folder), 5, seed=3)
    return cv.cross_validate(measured(spark, folder), folds, INPUTS, ["price"], k=5)


@query("k01_cross_validate", sql("SELECT exp_code, feature, round(mae, 4) AS mae, n_samples FROM cve", "experiments", "cells", extra=FOLDS))
def cross_validate(spark, folder):
    return errors(spark, folder).select("exp_code", "feature", F.round("mae", 4).alias("mae"), "n_samples")


PRICE = models.ModelSpec("price", tuple(INPUTS), ("price",))
#: One tree of one split on a feature of two values: its predictions are the means of both sides.
SPLIT_ONCE = models.ModelSpec("price", ("many",), ("price",), kind="gbt", options={"maxIter": 1, "maxDepth": 1})
BY_EXPERIMENT = FOLDS["cve"].replace("FROM cvp", "FROM {pairs}")
#: Doubles have about 15 digits: R² far below 0 is shown without decimals.
SHOWN = "SELECT exp_code, feature, round(mae, 4) AS mae, CASE WHEN r2 < -1000 THEN round(r2) ELSE round(r2, 6) END AS r2, n_samples FROM "


def held_out(spark, folder, spec, rows=None, norm=None):
    folds = sets.folds(tb.experiments(spark, folder), 5, seed=3)
    return cv.held_out(measured(spark, folder) if rows is None else rows, folds, [spec], norm)


def shown(predictions):
    return cv.experiment_errors(predictions, ["price"]).withColumns(
        {"mae": F.round("mae", 4), "r2": F.when(F.col("r2") < -1000, F.round("r2")).otherwise(F.round("r2", 6))}
    )


@query("k01_models_linear", sql(SHOWN + "cve", "experiments", "cells", extra=FOLDS))
def models_linear(spark, folder):
    return shown(held_out(spark, folder, PRICE, norm={"quantity": "standard", "price": "standard"}))


@query(
    "k01_models_formula",
    sql(
        SHOWN + "ruled", "experiments", "cells",
        extra={"pairs": "SELECT exp_code, 'price' AS feature, price AS truth, quantity * 1500 * (1 - discount) AS pred FROM cells", "ruled": BY_EXPERIMENT.format(pairs="pairs")},
    ),
)
def models_formula(spark, folder):
    rule = models.ModelSpec("rule", tuple(INPUTS), ("price",), formula={"price": F.col("quantity") * 1500 * (1 - F.col("discount"))})
    return shown(held_out(spark, folder, rule))


@query(
    "k01_models_trees",
    sql(
        SHOWN + "split", "experiments", "cells",
        extra={
            "fold": FOLDS["fold"], "held": FOLDS["held"],
            "side": "SELECT k AS fold, quantity >= 26 AS many, avg(price) AS pred FROM held, range(5) t(k) WHERE fold <> k GROUP BY 1, 2",
            "pairs": "SELECT exp_code, 'price' AS feature, price AS truth, pred FROM held JOIN side ON held.fold = side.fold AND many = (quantity >= 26)",
            "split": BY_EXPERIMENT.format(pairs="pairs"),
        },
    ),
)
def models_trees(spark, folder):
    rows = measured(spark, folder).withColumn("many", (F.col("quantity") >= 26).cast("double"))
    return shown(held_out(spark, folder, SPLIT_ONCE, rows))


@query(
    "k01_models_informed",
    sql(
        """SELECT feature, round(avg(abs(truth - pred)), 4) AS mae, round(1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*)), 6) AS r2,
        round(1 - sum(w * (truth - pred) ** 2) / sum(w * (truth - m) ** 2), 6) AS r2_inf, count(*) AS n_samples FROM weighed, middle GROUP BY 1""",
        "experiments", "cells",
        extra={
            **FOLDS,
            "weighed": "SELECT cvp.*, 0.1 + total / 500000 AS w FROM cvp JOIN experiments USING (exp_code)",
            "middle": "SELECT sum(w * truth) / sum(w) AS m FROM weighed",
        },
    ),
)
def models_informed(spark, folder):
    weights = tb.experiments(spark, folder).select("exp_code", F.lit("price").alias("feature"), (0.1 + F.col("total") / 500000).alias("importance"))
    out = metrics.validate(held_out(spark, folder, PRICE), ["price"], {}, weights)
    return out.select("feature", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("r2_inf", 6).alias("r2_inf"), "n_samples")


LOO = {
    "t": """SELECT count(*) AS n, sum(quantity - 25) AS s1, sum(discount) AS s2, sum((quantity - 25) ** 2) AS s11, sum(discount ** 2) AS s22,
        sum((quantity - 25) * discount) AS s12, sum(price - 50000) AS sy, sum((quantity - 25) * (price - 50000)) AS s1y, sum(discount * (price - 50000)) AS s2y FROM cells""",
    "e": """SELECT exp_code, count(*) AS n, sum(quantity - 25) AS s1, sum(discount) AS s2, sum((quantity - 25) ** 2) AS s11, sum(discount ** 2) AS s22,
        sum((quantity - 25) * discount) AS s12, sum(price - 50000) AS sy, sum((quantity - 25) * (price - 50000)) AS s1y, sum(discount * (price - 50000)) AS s2y
        FROM cells GROUP BY 1""",
    "d": """SELECT e.exp_code, t.n - e.n AS n, t.s1 - e.s1 AS s1, t.s2 - e.s2 AS s2, t.s11 - e.s11 AS s11, t.s22 - e.s22 AS s22, t.s12 - e.s12 AS s12,
        t.sy - e.sy AS sy, t.s1y - e.s1y AS s1y, t.s2y - e.s2y AS s2y FROM e, t""",
    "o": """SELECT exp_code, sy / n + 50000 AS my, s1 / n + 25 AS m1, s2 / n AS m2, s1y / n - s1 / n * sy / n AS c1, s2y / n - s2 / n * sy / n AS c2,
        s11 / n - (s1 / n) ** 2 AS v1, s22 / n - (s2 / n) ** 2 AS v2, s12 / n - s1 / n * s2 / n AS c12 FROM d""",
}


@query(
    "k01_leave_one_out",
    sql(f"SELECT exp_code, round(avg(abs(price - ({FIT}))), 2) AS mae FROM cells JOIN o USING (exp_code) GROUP BY 1", "cells", extra=LOO),
)
def leave_one_out(spark, folder):
    folds = sets.folds(tb.cells(spark, folder).select("exp_code").distinct(), None)
    out = cv.cross_validate(measured(spark, folder), folds, INPUTS, ["price"])
    return out.select("exp_code", F.round("mae", 2).alias("mae"))


@query(
    "k02_error_field",
    sql("SELECT exp_code, total, priority, round(mae, 4) AS error FROM cve JOIN experiments USING (exp_code)", "experiments", "cells", extra=FOLDS),
)
def error_field(spark, folder):
    params = tb.experiments(spark, folder).select("exp_code", "total", "priority")
    return cv.error_field(errors(spark, folder), params, "price").withColumn("error", F.round("error", 4))


@query(
    "k03_pooled",
    sql(
        "SELECT feature, round(sum(mae * n_samples) / sum(n_samples), 4) AS mae_mean, count(*) AS n_experiments, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM cve GROUP BY 1",
        "experiments", "cells", extra=FOLDS,
    ),
)
def pooled(spark, folder):
    return cv.pooled(errors(spark, folder)).withColumn("mae_mean", F.round("mae_mean", 4))


STAGES = [500, 1000, 2000]
STAGE_SQL = " UNION ALL ".join(
    f"""SELECT {k} AS stage, round(avg(abs(price - ({FIT}))), 4) AS mae, count(*) AS n_samples FROM probe,
    (SELECT {OLS} FROM cells WHERE exp_code IN (SELECT exp_code FROM members WHERE set_code = '2-HIGH' AND pos < {k}))"""
    for k in STAGES
)


@query(
    "k04_stage_errors",
    sql(STAGE_SQL, "experiments", "cells", extra={**MEMBERS, "probe": "SELECT * FROM cells WHERE exp_code IN (SELECT exp_code FROM experiments WHERE priority = '5-LOW')"}),
)
def stages(spark, folder):
    own = members(spark, folder).where("set_code = '2-HIGH'")
    probe = tb.experiments(spark, folder).where("priority = '5-LOW'")
    out = cv.stage_errors(own, measured(spark, folder), probe, STAGES, INPUTS, ["price"])
    return out.select("stage", F.round("mae", 4).alias("mae"), "n_samples")


DIAG = {
    **FOLDS,
    "paired": "SELECT exp_code, feature, mae AS error, total / 500000 AS coverage FROM cve JOIN experiments USING (exp_code)",
    "lab": """SELECT *, CASE WHEN error >= e AND coverage >= c THEN 'model_problem' WHEN error >= e THEN 'under_explored'
        WHEN coverage >= c THEN 'trustworthy' ELSE 'sparse_ok' END AS label
        FROM paired, (SELECT quantile_cont(error, 0.5) AS e, quantile_cont(coverage, 0.5) AS c FROM paired)""",
}


def diagnosed(spark, folder):
    coverage = tb.experiments(spark, folder).select("exp_code", (F.col("total") / 500000).alias("coverage"))
    return cv.diagnose(errors(spark, folder), coverage)


@query("k05_diagnose", sql("SELECT exp_code, feature, label FROM lab", "experiments", "cells", extra=DIAG))
def diagnose(spark, folder):
    return diagnosed(spark, folder).select("exp_code", "feature", "label")


@query(
    "k06_label_summary",
    sql(
        "SELECT label, count(lab.exp_code) AS n FROM (VALUES ('model_problem'), ('under_explored'), ('trustworthy'), ('sparse_ok')) l(label) LEFT JOIN lab USING (label) GROUP BY 1",
        "experiments", "cells", extra=DIAG,
    ),
)
def label_summary(spark, folder):
    return cv.label_summary(diagnosed(spark, folder))


def hashed(salt: str, key: str = "c_custkey") -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), 1, 7) AS BIGINT) / 268435456.0"


def base_points(spark, folder):
    """Uniform base points derived from the customers' keys."""
    rows_ = tb.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return rows_.withColumns({f"{m}{j}": sensitivity.hashed_unit("id", f"{m}{j}") for m in "ab" for j in range(3)})


NAMES = ["x0", "x1", "x2"]


def outputs():
    return {"heat": F.col("x0") + 2 * F.col("x1") * F.col("x2"), "flow": F.col("x1") * F.col("x1"), "still": F.lit(1.0)}


BASE = {
    "bp": "SELECT c_custkey AS id, " + ", ".join(f"{hashed(f'{m}{j}')} AS {m}{j}" for m in "ab" for j in range(3)) + " FROM customer",
    "des": """SELECT id, CAST(k AS INTEGER) AS block, CASE WHEN k IN (1, 4) THEN b0 ELSE a0 END AS x0, CASE WHEN k IN (2, 4) THEN b1 ELSE a1 END AS x1,
        CASE WHEN k IN (3, 4) THEN b2 ELSE a2 END AS x2 FROM bp, range(5) t(k)""",
    "evl": "SELECT *, x0 + 2 * x1 * x2 AS heat, x1 * x1 AS flow FROM des",
    "lng": """SELECT id, block, 'heat' AS output, (heat - avg(heat) OVER ()) / stddev_pop(heat) OVER () AS y FROM evl
        UNION ALL SELECT id, block, 'flow', (flow - avg(flow) OVER ()) / stddev_pop(flow) OVER () FROM evl""",
    "wid": "SELECT output, id, " + ", ".join(f"max(y) FILTER (block = {j}) AS y{j}" for j in range(5)) + " FROM lng GROUP BY 1, 2",
    "var": "SELECT output, (avg(y0 * y0) + avg(y4 * y4)) / 2 - ((avg(y0) + avg(y4)) / 2) ** 2 AS v FROM wid GROUP BY 1",
    "idx": " UNION ALL ".join(
        f"SELECT output, 'x{j}' AS input, avg(y4 * (y{j + 1} - y0)) / any_value(v) AS s1, avg((y0 - y{j + 1}) ** 2) / 2 / any_value(v) AS st FROM wid JOIN var USING (output) GROUP BY 1"
        for j in range(3)
    )
    + " UNION ALL SELECT 'still', i, 0.0, 0.0 FROM (VALUES ('x0'), ('x1'), ('x2')) t(i)",
}


@query("l01_saltelli", sql("SELECT id, block, round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2 FROM des", extra=BASE))
def saltelli(spark, folder):
    out = sensitivity.saltelli(base_points(spark, folder), "id", ["a0", "a1", "a2"], ["b0", "b1", "b2"], NAMES)
    return out.select("id", "block", *[F.round(c, 9).alias(c) for c in NAMES])


def evaluated(spark, folder):
    out = sensitivity.saltelli(base_points(spark, folder), "id", ["a0", "a1", "a2"], ["b0", "b1", "b2"], NAMES)
    return sensitivity.evaluate(out, outputs())


@query("l02_evaluate", sql("SELECT id, block, round(heat, 9) AS heat, round(flow, 9) AS flow FROM evl", extra=BASE))
def evaluate(spark, folder):
    return evaluated(spark, folder).select("id", "block", F.round("heat", 9).alias("heat"), F.round("flow", 9).alias("flow"))


def indices(spark, folder):
    return sensitivity.sobol_indices(evaluated(spark, folder), "id", NAMES, ["heat", "flow", "still"])


@query("l03_sobol_indices", sql("SELECT output, input, round(s1, 6) AS s1, round(st, 6) AS st FROM idx", extra=BASE))
def sobol_indices(spark, folder):
    return indices(spark, folder).select("output", "input", F.round("s1", 6).alias("s1"), F.round("st", 6).alias("st"))


@query("l03_sobol_confidence")
def sobol_confidence(spark, folder):
    return sensitivity.sobol_indices(evaluated(spark, folder), "id", NAMES, ["heat", "flow"], replicates=50)


MORRIS = {
    "lv": "SELECT c_custkey AS id, " + ", ".join(f"floor({hashed(f'0/level/x{j}')} * 4) AS g{j}, {hashed(f'0/order/x{j}')} AS h{j}" for j in range(3)) + " FROM customer",
    "od": """SELECT *, 1 + CAST(h1 < h0 AS INTEGER) + CAST(h2 < h0 AS INTEGER) AS p0, 1 + CAST(h0 < h1 AS INTEGER) + CAST(h2 < h1 AS INTEGER) AS p1,
        1 + CAST(h0 < h2 AS INTEGER) + CAST(h1 < h2 AS INTEGER) AS p2 FROM lv""",
    "pt": "SELECT id, s, p0, p1, p2, " + ", ".join(f"CASE WHEN g{j} < 2 THEN 2.0 / 3 ELSE -2.0 / 3 END AS d{j}, g{j} / 3.0 + CASE WHEN p{j} <= s THEN CASE WHEN g{j} < 2 THEN 2.0 / 3 ELSE -2.0 / 3 END ELSE 0 END AS x{j}" for j in range(3)) + " FROM od, range(4) t(s)",
    "pv": "SELECT *, x0 + 2 * x1 * x2 AS heat, x1 * x1 AS flow FROM pt",
    "ee": " UNION ALL ".join(
        f"SELECT '{o}' AS output, 'x{j}' AS input, (b.{o} - a.{o}) / b.d{j} AS e FROM pv a JOIN pv b ON a.id = b.id AND b.s = a.s + 1 AND b.p{j} = b.s"
        for o in ("heat", "flow") for j in range(3)
    ),
}


@query(
    "l04_morris",
    sql("SELECT output, input, round(avg(e), 6) AS mu, round(avg(abs(e)), 6) AS mu_star, round(stddev_samp(e), 6) AS sigma FROM ee GROUP BY 1, 2 UNION ALL SELECT 'still', i, 0.0, 0.0, 0.0 FROM (VALUES ('x0'), ('x1'), ('x2')) t(i)", extra=MORRIS),
)
def morris(spark, folder):
    base = tb.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    points = sensitivity.evaluate(sensitivity.morris_design(base, "id", NAMES), outputs())
    out = sensitivity.morris_indices(points, "id", ["heat", "flow", "still"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("mu", "mu_star", "sigma")})


@query("l05_flat_outputs", "SELECT 'still' AS output FROM customer LIMIT 1")
def flat(spark, folder):
    found = sensitivity.flat_outputs(evaluated(spark, folder), ["heat", "flow", "still"])
    return spark.createDataFrame([(o,) for o in found], "output string")


@query(
    "l07_top_k",
    sql(
        """SELECT output, input, round(st, 6) AS st FROM idx WHERE input IN (SELECT input FROM idx GROUP BY 1 ORDER BY max(st) DESC, input LIMIT 2)
        AND output IN (SELECT output FROM idx WHERE input IN (SELECT input FROM idx GROUP BY 1 ORDER BY max(st) DESC, input LIMIT 2)
        GROUP BY 1 ORDER BY max(st) DESC, output LIMIT 1)""",
        extra=BASE,
    ),
)
def top_k(spark, folder):
    return sensitivity.top_k(indices(spark, folder), "st", 2, 1).select("output", "input", F.round("st", 6).alias("st"))


def train(spark, folder):
    own = splits(spark, folder).where("split = 'train'").select("exp_code")
    return measured(spark, folder).join(own, "exp_code", "left_semi")


def fitted(spark, folder, kind: str = "linear"):
    data = train(spark, folder)
    x = prep.fit_norm(data, {"quantity": "standard", "discount": "min_max", "price": "standard"})
    y = {"price": replace(x.pop("price"), side="y")}
    spec = models.ModelSpec("price_model", ("quantity", "discount"), ("price",), kind)
    return models.fit([spec], data, x, y)


LEARN = {
    **SPLIT,
    "tr": "SELECT * FROM cells WHERE exp_code IN (SELECT exp_code FROM split WHERE split = 'train')",
    "lm": f"SELECT {OLS} FROM tr",
    "prd": f"SELECT exp_code, layer, price, quantity, {FIT} AS pred_price FROM cells, lm",
}


@query("m01_fit_trees")
def fit_trees(spark, folder):
    data = train(spark, folder)
    spec = models.ModelSpec("price_trees", ("quantity", "discount"), ("price",), "forest", options={"numTrees": 5, "maxDepth": 4})
    model = models.fit([spec], data, {}, {})
    return models.predict(measured(spark, folder), model).select("exp_code", "layer", "pred_price")


@query("m02_formula", sql("SELECT exp_code, layer, round(1500 * quantity * (1 - discount), 4) AS pred_price FROM cells", "cells"))
def formula(spark, folder):
    spec = models.ModelSpec("list", ("quantity", "discount"), ("price",), formula={"price": 1500 * F.col("quantity") * (1 - F.col("discount"))})
    out = models.predict(measured(spark, folder), models.Fitted([spec], {}, {}, {}))
    return out.select("exp_code", "layer", F.round("pred_price", 4).alias("pred_price"))


@query("m03_predict", sql("SELECT exp_code, layer, round(pred_price, 3) AS pred_price FROM prd", "experiments", "cells", extra=LEARN))
def predict(spark, folder):
    out = models.predict(measured(spark, folder), fitted(spark, folder))
    return out.select("exp_code", "layer", F.round("pred_price", 3).alias("pred_price"))


@query(
    "m03_predict_chain",
    sql("SELECT exp_code, layer, round(pred_price * 0.2 + quantity, 3) AS pred_cost FROM prd", "experiments", "cells", extra=LEARN),
)
def predict_chain(spark, folder):
    base = fitted(spark, folder)
    cost = models.ModelSpec("cost", ("price", "quantity"), ("cost",), formula={"cost": F.col("pred_price") * 0.2 + F.col("quantity")})
    both = models.Fitted(models.in_order([cost, *base.specs]), base.models, base.x_stats, base.y_stats)
    out = models.predict(measured(spark, folder), both)
    return out.select("exp_code", "layer", F.round("pred_cost", 3).alias("pred_cost"))


@query(
    "m04_predict_range",
    sql(
        """SELECT exp_code, cell_idx, round(arg_max(p, b), 6) AS pred FROM (SELECT exp_code, cell_idx, b, n - avg(n) OVER (PARTITION BY exp_code, b) AS p
        FROM (SELECT exp_code, cell_idx, coalesce(n, 0) AS n FROM ugrid LEFT JOIN ucells USING (exp_code, day, hour) WHERE cell_idx >= 24 AND cell_idx < 240), range(5) t(b)
        WHERE (cell_idx - 24) // 48 = b OR (b > 0 AND cell_idx >= 24 + b * 48 - 8 AND cell_idx < 24 + b * 48)) GROUP BY 1, 2""",
        "ugrid", "ucells",
    ),
)
def predict_range(spark, folder):
    full = grid.fill_grid(tb.user_cells(spark, folder), tb.users(spark, folder), DAYS, "n").select(
        "exp_code", "cell_idx", F.coalesce("n", F.lit(0)).alias("n")
    )

    def above_batch(batches):
        # A predictor that depends on its batch: each batch is bounded by the batch size.
        w = Window.partitionBy("exp_code", "batch_id")
        return batches.withColumn("pred", F.col("n") - F.avg("n").over(w))

    out = models.predict_range(full, above_batch, ["pred"], 24, 240, 48, 8)
    return out.withColumn("pred", F.round("pred", 6))


@query("m07_residual")
def residual(spark, folder):
    base = fitted(spark, folder)
    cells = measured(spark, folder).withColumn("cell_idx", F.col("layer").cast("long"))
    fix = models.fit_residual(cells, base, 0, 3)
    return models.predict_corrected(cells, base, fix).select("exp_code", "layer", "pred_price")


@query("m08_bundle_predict", sql("SELECT exp_code, layer, round(pred_price, 3) AS price FROM prd", "experiments", "cells", extra=LEARN))
def bundle(spark, folder):
    own = measured(spark, folder).select("exp_code", "layer", *INPUTS)
    out = models.bundle_predict(own, fitted(spark, folder), ["exp_code", "layer"])
    return out.withColumn("price", F.round("price", 3))


@query(
    "m09_predict_performance",
    sql(
        "SELECT exp_code AS cand_id, round(avg(greatest(0, least(1, 1 - abs(pred_price - 40000) / 40000))), 6) AS perf FROM prd GROUP BY 1",
        "experiments", "cells", extra=LEARN,
    ),
)
def performance(spark, folder):
    cells = measured(spark, folder).withColumnRenamed("exp_code", "cand_id")
    expr = 1 - F.abs(F.col("price") - 40000) / 40000
    out = models.predict_performance(cells, fitted(spark, folder), ["price"], expr)
    return out.withColumn("perf", F.round("perf", 6))


@query(
    "m10_context_snapshot",
    """SELECT s_suppkey AS cand_id, (SELECT arg_max(value, ts) FROM events WHERE event_type = 'view') AS view,
       (SELECT arg_max(value, ts) FROM events WHERE event_type = 'error') AS error FROM supplier""",
)
def context(spark, folder):
    out = models.with_context(tb.candidates(spark, folder), tb.table(spark, folder, "events"), "event_type", "value", "ts", ["view", "error"])
    return out.select("cand_id", "view", "error")


@query(
    "v01_error_grid",
    sql("SELECT layer, round(avg(abs(price - 1500 * quantity)), 4) AS mean_error FROM cells GROUP BY 1", "cells"),
)
def error_grid(spark, folder):
    cells = tb.cells(spark, folder)
    truth = cells.select("exp_code", "layer", F.col("price").alias("value"))
    pred = cells.select("exp_code", "layer", (1500 * F.col("quantity")).alias("value"))
    out = report.mean_error(report.error_grid(truth, pred, ["exp_code", "layer"]), ["layer"])
    return out.withColumn("mean_error", F.round("mean_error", 4))


DAYGRID = {
    "dg": "SELECT day, hour, round(sum(value), 2) AS total, CAST(sum(n) AS BIGINT) AS n FROM ucells GROUP BY 1, 2",
}


def day_grid(spark, folder):
    return tb.user_cells(spark, folder).groupBy("day", "hour").agg(F.round(F.sum("value"), 2).alias("total"), F.sum("n").alias("n"))


@query(
    "v02_grid_optima",
    sql(
        """(SELECT 'total' AS metric, day, hour, total AS value FROM dg ORDER BY total DESC, day, hour LIMIT 1)
        UNION ALL (SELECT 'n', day, hour, CAST(n AS DOUBLE) FROM dg ORDER BY n DESC, day, hour LIMIT 1)""",
        "ucells", extra=DAYGRID,
    ),
)
def optima(spark, folder):
    return report.grid_optima(day_grid(spark, folder), "day", "hour", {"total": F.col("total"), "n": F.col("n").cast("double")})


@query("v03_slice_nearest", sql("SELECT day, hour, total FROM dg WHERE hour = 7", "ucells", extra=DAYGRID))
def slice_nearest(spark, folder):
    return report.slice_nearest(day_grid(spark, folder), "hour", 7.3).select("day", "hour", "total")


@query(
    "v04_parallel_rows",
    sql(
        "SELECT exp_code, 'total' AS param, round((total - 1000) / 399000, 9) AS position FROM experiments UNION ALL SELECT exp_code, 'cust', 0.5 FROM experiments",
        "experiments",
    ),
)
def parallel(spark, folder):
    out = report.parallel_rows(tb.experiments(spark, folder), "exp_code", {"total": (1000.0, 400000.0), "cust": None})
    return out.withColumn("position", F.round("position", 9))


TRUST = {
    "gp": GRID_POINTS,
    "ge": f"SELECT ix, iy, sum(k.w * {gauss('g', 'k')}) / (1 + sum(k.w * {gauss('g', 'k')})) AS e FROM gp g, kernels k GROUP BY 1, 2",
}


@query(
    "v05_trust_mask",
    sql("SELECT ix, iy, round(least(1, e / 0.9), 6) AS trust, e >= 0.9 AS trusted FROM ge", "kernels", extra=TRUST),
)
def trust(spark, folder):
    out = ev.with_density(grid_points(spark), fit(spark, folder, marginal_weight=1.0)).withColumn("e", ev.evidence(F.col("density")))
    return report.trust_mask(out, "e", 0.9).select("ix", "iy", F.round("trust", 6).alias("trust"), "trusted")


@query(
    "v06_evolution",
    sql(
        """SELECT set_code, CAST(k AS INTEGER) AS round, count(*) AS n_members, round(avg(total), 4) AS mean, max(total) AS best,
        (SELECT min(total) FROM members JOIN experiments USING (exp_code) WHERE pos < 300) AS shared_min,
        (SELECT max(total) FROM members JOIN experiments USING (exp_code) WHERE pos < 300) AS shared_max
        FROM members JOIN experiments USING (exp_code), (VALUES (100), (200), (300)) r(k) WHERE pos < k GROUP BY 1, 2""",
        "experiments", extra=MEMBERS,
    ),
)
def evolution(spark, folder):
    totals = tb.experiments(spark, folder).select("exp_code", "total")
    out = report.evolution(members(spark, folder), totals, [100, 200, 300], "total")
    return out.withColumn("mean", F.round("mean", 4))


@query(
    "v07_trajectory_points",
    sql(
        """SELECT g.exp_code, g.day, coalesce(arg_max(u.value, u.seq), 0.0) AS click FROM (SELECT DISTINCT exp_code, day FROM ugrid) g
        LEFT JOIN ups u ON u.exp_code = g.exp_code AND u.param = 'click' AND (u.iterator_code IS NULL OR (u.iterator_code = 'n_days' AND u.step_index <= g.day)) GROUP BY 1, 2""",
        "ugrid", "ups",
    ),
)
def trajectory_points(spark, folder):
    out = report.trajectory_points(tb.users(spark, folder), tb.updates(spark, folder), tb.DAY, EVENTS)
    return out.select("exp_code", "day", "click")


@query(
    "v08_best_starts",
    """SELECT user_id AS start, min(value) AS lowest, row_number() OVER (ORDER BY min(value), user_id) = 1 AS is_best FROM events GROUP BY 1""",
)
def best_starts(spark, folder):
    history = tb.table(spark, folder, "events").select(F.col("user_id").alias("start"), F.col("value").alias("objective"))
    low, _ = report.best_starts(history)
    return report.ranked_starts(low)


@query(
    "v09_metric_table",
    sql(
        f"""SELECT 'mae' AS metric, round(max(mae) FILTER (feature = 'discount'), 6) AS discount, round(max(mae) FILTER (feature = 'price'), 6) AS price FROM m
        UNION ALL SELECT 'r2', round(max(r2) FILTER (feature = 'discount'), 6), round(max(r2) FILTER (feature = 'price'), 6) FROM m
        UNION ALL SELECT 'n_samples', max(n) FILTER (feature = 'discount'), max(n) FILTER (feature = 'price') FROM m""",
        "cells", extra={**PRED, "m": f"SELECT feature, avg(abs(truth - pred)) AS mae, {R2} AS r2, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY 1"},
    ),
)
def metric_table(spark, folder):
    out = report.metric_table(metrics.regression_metrics(predictions(spark, folder)), features=["discount", "price"])
    return out.withColumns({c: F.round(c, 6) for c in ("discount", "price")})

