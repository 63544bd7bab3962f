"""Preparation, feature, scoring and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlattice.operators import features, grid, metrics, prep, quality, scoring
from runlattice.plans.base import query, sql
from runlattice.plans.catalog import SPLIT, splits
from runlattice.plans.grids import DAYS, EVENTS, LAYERS
from runlattice.sources import tables as tb

MEASURED = ["quantity", "price", "discount"]


def rows(spark, folder):
    """Training rows: every cell with its experiment's inputs and measured targets."""
    full = grid.expand_domain(tb.sized_experiments(spark, folder), LAYERS)
    return grid.with_positions(full, LAYERS).join(tb.cells(spark, folder).hint("merge"), ["exp_code", "layer"], "left")


ROWS = {
    "rows": """SELECT g.*, g.layer / greatest(g.n_layers - 1, 1) AS layer_pos, c.quantity, c.price, c.discount
        FROM grid g LEFT JOIN cells c USING (exp_code, layer)""",
}


def train_rows(spark, folder):
    train = splits(spark, folder).where("split = 'train'").select("exp_code")
    return rows(spark, folder).join(train, "exp_code", "left_semi")


TRAIN = {**ROWS, **SPLIT, "train": "SELECT * FROM rows WHERE exp_code IN (SELECT exp_code FROM split WHERE split = 'train')"}
VIEWS = ("experiments", "sized", "grid", "cells")


@query(
    "c16_export_rows",
    sql(
        """SELECT exp_code, cell_idx, layer, total, n_layers, round(layer_pos, 9) AS layer_pos, quantity, price FROM rows""",
        *VIEWS, extra=ROWS,
    ),
)
def export(spark, folder):
    return rows(spark, folder).select(
        "exp_code", "cell_idx", "layer", "total", "n_layers", F.round("layer_pos", 9).alias("layer_pos"), "quantity", "price"
    )


@query(
    "e01_fit_norm",
    sql(
        """SELECT 'total' AS column, 'standard' AS method, round(avg(total), 4) AS mean, round(stddev_pop(total), 4) AS std,
        min(total) AS min, max(total) AS max, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3 FROM train
        UNION ALL SELECT 'quantity', 'min_max', round(avg(quantity), 4), round(stddev_pop(quantity), 4), min(quantity), max(quantity), NULL, NULL, NULL FROM train
        UNION ALL SELECT 'price', 'robust', NULL, NULL, min(price), max(price), percentile_disc(0.5) WITHIN GROUP (ORDER BY price),
        round(quantile_cont(price, 0.25), 6), round(quantile_cont(price, 0.75), 6) FROM train""",
        *VIEWS, extra=TRAIN,
    ),
)
def fit(spark, folder):
    stats = prep.fit_norm(train_rows(spark, folder), {"total": "standard", "quantity": "min_max", "price": "robust", "discount": "none"})
    out = prep.stats_table(spark, stats).drop("side")
    digits = {"mean": 4, "std": 4, "q1": 6, "q3": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


NORMED = {
    **TRAIN,
    "st": """SELECT avg(total) AS m, stddev_pop(total) AS s, min(quantity) AS lo, max(quantity) AS hi,
        percentile_disc(0.5) WITHIN GROUP (ORDER BY price) AS med, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM train""",
}


def fitted(spark, folder, *columns):
    methods = {"total": "standard", "quantity": "min_max", "price": "robust"}
    return prep.fit_norm(train_rows(spark, folder), {c: m for c, m in methods.items() if c in (columns or methods)})


@query(
    "e03_apply_norm",
    sql(
        """SELECT exp_code, cell_idx, round((total - m) / (s + 1e-8), 6) AS total, round((quantity - lo) / (hi - lo + 1e-8), 6) AS quantity,
        round((price - med) / (iqr + 1e-8), 6) AS price FROM rows, st""",
        *VIEWS, extra=NORMED,
    ),
)
def normed(spark, folder):
    out = prep.apply_norm(rows(spark, folder), fitted(spark, folder))
    return out.select("exp_code", "cell_idx", *[F.round(c, 6).alias(c) for c in ("total", "quantity", "price")])


@query(
    "e03_reverse_norm",
    sql("SELECT exp_code, cell_idx, round(total, 2) AS total, quantity, round(price, 2) AS price FROM rows", *VIEWS, extra=ROWS),
)
def reversed_(spark, folder):
    stats = fitted(spark, folder)
    out = prep.reverse_norm(prep.apply_norm(rows(spark, folder), stats), stats)
    return out.select("exp_code", "cell_idx", F.round("total", 2).alias("total"), F.round("quantity", 2).alias("quantity"), F.round("price", 2).alias("price"))


@query(
    "e04_normalize_bounds",
    sql(
        """SELECT exp_code, round((least(total, 2 * m - total) - m) / (s + 1e-8), 6) AS lo, round((greatest(total, 2 * m - total) - m) / (s + 1e-8), 6) AS hi
        FROM experiments, st""",
        *VIEWS, extra=NORMED,
    ),
)
def bounds(spark, folder):
    stats = fitted(spark, folder, "total")
    other = F.lit(2 * stats["total"].mean) - F.col("total")
    lo, hi = prep.normalize_bounds(stats, "total", F.col("total"), other)
    return tb.experiments(spark, folder).select("exp_code", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    "e05_category_index",
    sql(
        """SELECT exp_code, CAST(CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS BIGINT) AS idx
        FROM experiments""",
        "experiments",
    ),
)
def category(spark, folder):
    idx = prep.category_index(F.col("priority"), ["3-MEDIUM", "1-URGENT", "2-HIGH"])
    return tb.experiments(spark, folder).select("exp_code", idx.alias("idx"))


@query(
    "e06_decode",
    sql(
        """SELECT exp_code, round(total, 3) AS total, CASE WHEN cust % 7 = 0 THEN 'F' WHEN cust % 7 = 1 THEN 'O' ELSE 'P' END AS status
        FROM experiments""",
        "experiments",
    ),
)
def decode(spark, folder):
    from runlattice.schema import Param

    stats = fitted(spark, folder, "total")
    scaled = prep.apply_norm(
        tb.experiments(spark, folder).select("exp_code", "total", (F.col("cust") % 7).cast("double").alias("status"), F.lit(1.0).alias("humidity")),
        {"total": stats["total"]},
    )
    spec = [Param("total", digits=3), Param("status", "category", vocab=tb.STATUSES), Param("humidity")]
    return prep.decode(scaled, spec, {"total": stats["total"]}, context=["humidity"])


@query(
    "e07_lag",
    sql(
        """SELECT exp_code, cell_idx, CASE WHEN cell_idx >= 2 THEN lag(quantity, 2) OVER w ELSE quantity END AS prev_quantity FROM rows
        WINDOW w AS (PARTITION BY exp_code ORDER BY cell_idx)""",
        *VIEWS, extra=ROWS,
    ),
)
def lagged(spark, folder):
    return prep.add_lags(rows(spark, folder), ["quantity"], k=2).select("exp_code", "cell_idx", "prev_quantity")


@query(
    "e08_context",
    sql("SELECT exp_code, cell_idx, discount AS ctx_discount, quantity, price FROM rows", *VIEWS, extra=ROWS),
)
def context(spark, folder):
    out, outputs = prep.inject_context(rows(spark, folder), ["discount"], MEASURED)
    return out.select("exp_code", "cell_idx", "ctx_discount", *outputs)


@query(
    "e09_exclude_rows",
    sql("SELECT round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS std FROM train WHERE layer NOT IN (0, 3)", *VIEWS, extra=TRAIN),
)
def excluded(spark, folder):
    kept = prep.exclude_rows(train_rows(spark, folder), {"layer": [0, 3]})
    out = prep.stats_table(spark, prep.fit_norm(kept, {"quantity": "standard"}))
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "e10_drop_missing_targets",
    sql("SELECT exp_code, cell_idx, quantity, price FROM rows WHERE quantity IS NOT NULL AND price IS NOT NULL", *VIEWS, extra=ROWS),
)
def complete_targets(spark, folder):
    kept, _ = prep.drop_missing_targets(rows(spark, folder), ["quantity", "price"])
    return kept.select("exp_code", "cell_idx", "quantity", "price")


@query(
    "e11_fill_inputs",
    sql("SELECT exp_code, cell_idx, coalesce(discount, 0) AS discount, CAST(0 AS DOUBLE) AS humidity FROM rows", *VIEWS, extra=ROWS),
)
def filled(spark, folder):
    return prep.fill_inputs(rows(spark, folder), ["discount", "humidity"]).select("exp_code", "cell_idx", "discount", "humidity")


@query(
    "e12_batches",
    sql(
        """SELECT exp_code, cell_idx, row_pos, CAST(row_pos // 256 AS BIGINT) AS batch_id FROM
        (SELECT exp_code, cell_idx, row_number() OVER (ORDER BY exp_seq, cell_idx) - 1 AS row_pos FROM rows)""",
        *VIEWS, extra=ROWS,
    ),
)
def batch(spark, folder):
    return prep.batches(rows(spark, folder), 256).select("exp_code", "cell_idx", "row_pos", "batch_id")


def user_scores(spark, folder):
    """Long scores per user: one per event type seen with a value of at least 5."""
    ev = tb.table(spark, folder, "events").where("value >= 5")
    return ev.groupBy(F.col("user_id").alias("exp_code"), F.col("event_type").alias("perf_code")).agg(
        F.round(F.least(F.max("value") / 200.0, F.lit(1.0)), 6).alias("score")
    )


USCORES = {
    "us": """SELECT user_id AS exp_code, event_type AS perf_code, round(least(max(value) / 200.0, 1.0), 6) AS score
        FROM events WHERE value >= 5 GROUP BY 1, 2""",
}


def _calibration_sql():
    best = ", ".join(f"coalesce(arg_max(value, seq) FILTER (param = '{e}'), 0.0) AS {e}" for e in EVENTS)
    return sql(
        f"""SELECT p.*, c.s_click, e.s_error FROM (SELECT g.exp_code, {best} FROM ugrid g LEFT JOIN ups u ON u.exp_code = g.exp_code
        AND (u.iterator_code IS NULL OR g.cell_idx >= u.step_index * CASE u.iterator_code WHEN 'n_days' THEN g.n_hours ELSE 1 END)
        WHERE g.cell_idx = g.n_days * g.n_hours - 1 GROUP BY 1) p
        JOIN (SELECT exp_code, score AS s_click FROM us WHERE perf_code = 'click') c USING (exp_code)
        JOIN (SELECT exp_code, score AS s_error FROM us WHERE perf_code = 'error') e USING (exp_code)""",
        "ugrid", "ups", extra=USCORES,
    )


@query("e14_calibration_arrays", _calibration_sql())
def calibration(spark, folder):
    scores = user_scores(spark, folder).withColumn("perf_code", F.concat(F.lit("s_"), "perf_code"))
    return prep.calibration_arrays(
        tb.users(spark, folder), tb.updates(spark, folder), scores, DAYS, EVENTS, ["s_click", "s_error"], strict=False
    )


@query(
    "e15_flat_batch",
    sql(
        """SELECT exp_code, cell_idx, round((total - m) / (s + 1e-8), 6) AS total, round(layer / greatest(n_layers - 1, 1), 9) AS layer_pos FROM grid, st""",
        *VIEWS, extra=NORMED,
    ),
)
def flat(spark, folder):
    stats = fitted(spark, folder, "total")
    out = prep.flat_batch(tb.sized_experiments(spark, folder), LAYERS, stats)
    return out.select("exp_code", "cell_idx", F.round("total", 6).alias("total"), F.round("layer_pos", 9).alias("layer_pos"))


@query(
    "e16_sequence_batch",
    sql(
        """SELECT s.exp_code, CAST(u.i AS INTEGER) AS step, coalesce(r.layer_pos, 0) AS x, r.quantity AS y,
        CASE WHEN r.quantity IS NULL THEN 0 ELSE 1 END AS mask
        FROM (SELECT * FROM sized WHERE n_layers > 0) s, unnest(range(7)) AS u(i)
        LEFT JOIN (SELECT exp_code, layer, round(layer_pos, 9) AS layer_pos, quantity FROM rows) r ON r.exp_code = s.exp_code AND r.layer = u.i""",
        *VIEWS, extra=ROWS,
    ),
)
def sequences(spark, folder):
    cells = rows(spark, folder).withColumn("layer_pos", F.round("layer_pos", 9))
    seq = prep.sequence_batch(cells, ["exp_code"], tb.LAYER, ["layer_pos"], ["quantity"])
    return seq.select("exp_code", F.posexplode(F.arrays_zip("steps", "mask")).alias("step", "z")).select(
        "exp_code", "step", F.col("z.steps.layer_pos").alias("x"), F.col("z.steps.quantity").alias("y"), F.col("z.mask").alias("mask")
    )


@query(
    "e18_unit_frame",
    sql(
        """SELECT exp_code, round((total - lo) / (hi - lo), 6) AS unit, round((cust - clo) / (chi - clo), 6) AS cust_unit
        FROM experiments, (SELECT min(total) AS lo, max(total) AS hi, min(cust)::DOUBLE AS clo, max(cust) AS chi FROM experiments)""",
        "experiments",
    ),
)
def unit(spark, folder):
    exps = tb.experiments(spark, folder)
    ends = exps.agg(F.min("total").alias("lo"), F.max("total").alias("hi"), F.min("cust").alias("clo"), F.max("cust").alias("chi"))
    e = {c: ends.select(c).scalar() for c in ends.columns}
    return exps.select(
        "exp_code",
        F.round(prep.to_unit(F.col("total"), e["lo"], e["hi"]), 6).alias("unit"),
        F.round(prep.value_to_unit(F.col("cust"), e["clo"], e["chi"]), 6).alias("cust_unit"),
    )


F1 = "0.001 * total + 0.1 * layer"


@query("f01_extract", sql(f"SELECT exp_code, cell_idx, round({F1}, 6) AS heat, round(0.5 * total - 0.05 * layer, 6) AS flow FROM grid", "grid"))
def extract(spark, folder):
    out = features.extract(
        tb.sized_experiments(spark, folder), tb.updates(spark, folder), LAYERS, ["total"],
        outputs={"heat": F.round(0.001 * F.col("total") + 0.1 * F.col("layer"), 6), "flow": F.round(0.5 * F.col("total") - 0.05 * F.col("layer"), 6)},
    )
    return out.drop("layer")


GAP = sql(
    """SELECT g.exp_code, g.cell_idx, round(coalesce(b.click, 0) - coalesce(b.view, 0), 6) AS gap FROM ugrid g
    LEFT JOIN (SELECT g.exp_code, g.cell_idx, arg_max(value, seq) FILTER (param = 'click') AS click,
    arg_max(value, seq) FILTER (param = 'view') AS view FROM ugrid g JOIN ups u ON u.exp_code = g.exp_code
    AND (u.iterator_code IS NULL OR g.cell_idx >= u.step_index * CASE u.iterator_code WHEN 'n_days' THEN g.n_hours ELSE 1 END)
    GROUP BY 1, 2) b ON b.exp_code = g.exp_code AND b.cell_idx = g.cell_idx""",
    "ugrid", "ups",
)


@query("f01_extract_function", GAP)
def extract_function(spark, folder):
    """User Python on Arrow batches, with the parameters in force at each cell."""

    def gap(batch):
        return batch.assign(gap=(batch["click"] - batch["view"]).round(6))[["gap"]]

    out = features.extract(
        tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS, function=gap, names=["gap"]
    )
    return out.select("exp_code", "cell_idx", "gap")


@query(
    "f02_raw_loader",
    sql(
        """SELECT exp_code, cell_idx, round(coalesce(value, 0) / coalesce(n, 1), 6) AS mean_value
        FROM ugrid LEFT JOIN ucells USING (exp_code, day, hour)""",
        "ugrid", "ucells",
    ),
)
def raw(spark, folder):
    ratio = F.round(F.coalesce("value", F.lit(0.0)) / F.coalesce("n", F.lit(1)), 6)
    out = features.extract(
        tb.users(spark, folder), tb.updates(spark, folder), DAYS, ["click"], outputs={"mean_value": ratio},
        raw=tb.user_cells(spark, folder)
    )
    return out.select("exp_code", "cell_idx", "mean_value")


@query(
    "f03_derived",
    sql("SELECT exp_code, cell_idx, round(price / quantity, 9) AS unit_price FROM grid LEFT JOIN cells USING (exp_code, layer)", "grid", "cells"),
)
def derived(spark, folder):
    upstream = tb.cells(spark, folder)
    out = features.extract(
        tb.sized_experiments(spark, folder), tb.updates(spark, folder), LAYERS, ["total"],
        outputs={"unit_price": F.round(F.col("price") / F.col("quantity"), 9)}, upstream=upstream,
    )
    return out.select("exp_code", "cell_idx", "unit_price")


@query(
    "f05_incremental",
    sql(
        """SELECT s.exp_code, f.feature FROM sized s LEFT JOIN (SELECT exp_code, count(price) AS n FROM cells GROUP BY 1) c USING (exp_code),
        (VALUES ('unit_price'), ('price_share')) f(feature) WHERE coalesce(c.n, 0) < s.n_layers""",
        "sized", "cells",
    ),
)
def incremental(spark, folder):
    sized = tb.sized_experiments(spark, folder)
    done = quality.complete_in_range(sized, tb.cells(spark, folder), LAYERS, "price").where("complete")
    have = done.select("exp_code", F.explode(F.lit(["unit_price", "price_share"])).alias("feature"))
    return features.pending(sized, have, ["unit_price", "price_share"])


@query(
    "f06_split_outputs",
    sql(
        "SELECT exp_code, layer, 'quantity' AS feature, quantity AS value FROM cells UNION ALL SELECT exp_code, layer, 'price', price FROM cells",
        "cells",
    ),
)
def outputs(spark, folder):
    return features.split_outputs(tb.cells(spark, folder), ["exp_code", "layer"], ["quantity", "price"])


def scorers():
    """Score definitions: closeness to a target."""
    return {
        "s_quantity": (["quantity"], 1 - F.abs(F.col("quantity") - 25) / 25),
        "s_price": (["price"], 1 - F.abs(F.col("price") - 40000) / 40000),
        "s_discount": (["discount"], 1 - F.abs(F.col("discount") - 0.05) / 0.05),
    }


LONG_SCORES = {
    "ls": """SELECT exp_code, 's_quantity' AS perf_code, avg(s_quantity) AS score FROM scores GROUP BY 1
        UNION ALL SELECT exp_code, 's_price', avg(s_price) FROM scores GROUP BY 1
        UNION ALL SELECT exp_code, 's_discount', avg(s_discount) FROM scores GROUP BY 1""",
}


def long_scores(spark, folder):
    return scoring.evaluate(tb.cells(spark, folder), scorers())


@query("g01_score_rows", sql("SELECT exp_code, layer, round(s_price, 9) AS score FROM scores", "scores"))
def score_rows(spark, folder):
    ins, expr = scorers()["s_price"]
    out = scoring.score_rows(tb.cells(spark, folder), ins, expr)
    return out.select("exp_code", "layer", F.round("score", 9).alias("score"))


@query("g02_score_mean", sql("SELECT exp_code, round(avg(s_price), 10) AS score FROM scores GROUP BY 1", "scores"))
def score_mean(spark, folder):
    ins, expr = scorers()["s_price"]
    out = scoring.score_experiments(scoring.score_rows(tb.cells(spark, folder), ins, expr))
    return out.select("exp_code", F.round("score", 10).alias("score"))


@query(
    "g03_aggregate_then_score",
    sql("SELECT exp_code, round(greatest(0, least(1, 1 - abs(sum(quantity) - 100) / 100)), 9) AS score FROM cells GROUP BY 1", "cells"),
)
def aggregate_score(spark, folder):
    expr = 1 - F.abs(F.col("quantity") - 100) / 100
    out = scoring.aggregate_then_score(tb.cells(spark, folder), ["quantity"], "sum", expr)
    return out.select("exp_code", F.round("score", 9).alias("score"))


@query(
    "g04_score_candidates",
    sql(
        """SELECT exp_code AS cand_id, round(CASE WHEN count(q) = count(*) THEN avg(greatest(0, least(1, 1 - abs(q - 25) / 25))) ELSE 0 END, 9) AS score
        FROM (SELECT g.exp_code, c.quantity AS q FROM grid g LEFT JOIN cells c USING (exp_code, layer)) GROUP BY 1""",
        "grid", "cells",
    ),
)
def score_candidates(spark, folder):
    ins, expr = scorers()["s_quantity"]
    cells = rows(spark, folder).withColumnRenamed("exp_code", "cand_id")
    out = scoring.score_candidates(cells, ins, expr)
    return out.select("cand_id", F.round("score", 9).alias("score"))


@query(
    "g05_evaluate",
    sql(
        """SELECT exp_code, perf_code, round(score, 10) AS score FROM (
        SELECT * FROM ls WHERE NOT (perf_code = 's_price' AND exp_code IN (SELECT exp_code FROM experiments WHERE total >= 200000))
        UNION ALL SELECT exp_code, 's_price', 0.5 FROM experiments WHERE total >= 200000)""",
        "experiments", "scores", extra=LONG_SCORES,
    ),
)
def evaluate(spark, folder):
    held = tb.experiments(spark, folder).where("total >= 200000").select("exp_code", F.lit("s_price").alias("perf_code"), F.lit(0.5).alias("score"))
    out = scoring.evaluate(tb.cells(spark, folder), scorers(), stored=held)
    return out.withColumn("score", F.round("score", 10))


@query(
    "g06_combined_score",
    sql(
        """SELECT exp_code, round(sum(w * score) / sum(w), 10) AS combined FROM ls JOIN (VALUES ('s_quantity', 2.0), ('s_price', 1.3)) t(perf_code, w)
        USING (perf_code) GROUP BY 1""",
        "scores", extra=LONG_SCORES,
    ),
)
def combined(spark, folder):
    out = scoring.combined_score(long_scores(spark, folder), {"s_quantity": 2.0, "s_price": 1.3})
    return out.withColumn("combined", F.round("combined", 10))


@query(
    "g07_normalized_scores",
    sql(
        """SELECT exp_code, perf_code, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) AS normalized
        FROM ls WINDOW w AS (PARTITION BY perf_code)""",
        "scores", extra=LONG_SCORES,
    ),
)
def normalized(spark, folder):
    out = scoring.normalized_scores(long_scores(spark, folder))
    return out.select("exp_code", "perf_code", F.round("normalized", 9).alias("normalized"))


@query(
    "g08_score_summary",
    sql(
        """SELECT perf_code, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS lowest,
        round(max(score), 6) AS highest, count(score) AS n FROM ls GROUP BY 1""",
        "scores", extra=LONG_SCORES,
    ),
)
def summary(spark, folder):
    out = scoring.score_summary(long_scores(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "lowest", "highest")})


PRED = {
    "pred": """SELECT exp_code, layer, 'price' AS feature, price AS truth, 1500.0 * quantity AS pred FROM cells
        UNION ALL SELECT exp_code, layer, 'discount', discount, 0.04 + 0.0004 * quantity FROM cells""",
}


def predictions(spark, folder):
    cells = tb.cells(spark, folder)
    pairs = F.explode(
        F.array(
            F.struct(F.lit("price").alias("feature"), F.col("price").alias("truth"), (1500.0 * F.col("quantity")).alias("pred")),
            F.struct(F.lit("discount").alias("feature"), F.col("discount").alias("truth"), (0.04 + 0.0004 * F.col("quantity")).alias("pred")),
        )
    )
    return cells.select("exp_code", "layer", pairs.alias("r")).select("exp_code", "layer", "r.*")


R2 = "1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(*))"


@query(
    "h01_regression_metrics",
    sql(f"SELECT feature, round(avg(abs(truth - pred)), 6) AS mae, round({R2}, 6) AS r2, count(*) AS n_samples FROM pred GROUP BY 1", "cells", extra=PRED),
)
def regression(spark, folder):
    return metrics.regression_metrics(predictions(spark, folder)).withColumns({c: F.round(c, 6) for c in ("mae", "r2")})


INFORMED = {
    **PRED,
    "w": "SELECT exp_code, 0.1 + 0.9 / (1 + exp(-0.8 / std * (s - m))) AS imp FROM (SELECT exp_code, s, avg(s) OVER () AS m, stddev_pop(s) OVER () AS std FROM (SELECT exp_code, avg(s_price) AS s FROM scores GROUP BY 1))",
    "wp": "SELECT *, sum(imp * truth) OVER (PARTITION BY feature) / sum(imp) OVER (PARTITION BY feature) AS wm FROM pred JOIN w USING (exp_code)",
    "inf": f"""SELECT feature, {R2} AS r2, 1 - sum(imp * (truth - pred) ** 2) / sum(imp * (truth - wm) ** 2) AS r2_inf, count(*) AS n_samples FROM wp GROUP BY 1""",
}


def price_importance(spark, folder):
    scores = long_scores(spark, folder).where("perf_code = 's_price'")
    return metrics.importance(scores).select("exp_code", "importance")


@query(
    "h02_informed_r2",
    sql("SELECT feature, round(r2, 6) AS r2, round(r2_inf, 6) AS r2_inf, n_samples FROM inf", "cells", "scores", extra=INFORMED),
)
def informed(spark, folder):
    weighted = metrics.expand_to_rows(predictions(spark, folder), price_importance(spark, folder), "importance")
    out = metrics.informed_r2(weighted, "importance").drop("r2_gap")
    return out.withColumns({c: F.round(c, 6) for c in ("r2", "r2_inf")})


@query("h03_importance", sql("SELECT exp_code, round(imp, 6) AS importance FROM w", "cells", "scores", extra=INFORMED))
def importance(spark, folder):
    return price_importance(spark, folder).withColumn("importance", F.round("importance", 6))


FEATURE_WEIGHTS = {
    **LONG_SCORES,
    "filled": """SELECT e.exp_code, p.perf_code, coalesce(ls.score, 0) AS s FROM experiments e, (VALUES ('s_quantity'), ('s_price')) p(perf_code)
        LEFT JOIN ls ON ls.exp_code = e.exp_code AND ls.perf_code = p.perf_code""",
    "curve": """SELECT exp_code, perf_code, 0.1 + 0.9 / (1 + exp(-0.8 / stddev_pop(s) OVER w * (s - avg(s) OVER w))) AS imp
        FROM filled WINDOW w AS (PARTITION BY perf_code)""",
}


@query(
    "h04_feature_importance",
    sql(
        """SELECT exp_code, feature, round(imp, 6) AS importance FROM curve JOIN (VALUES ('s_quantity', 'quantity'), ('s_price', 'price'),
        ('s_price', 'unit_price')) f(perf_code, feature) USING (perf_code)""",
        "experiments", "scores", extra=FEATURE_WEIGHTS,
    ),
)
def feature_weights(spark, folder):
    out = metrics.feature_importance(
        tb.experiments(spark, folder), long_scores(spark, folder), {"s_quantity": ["quantity"], "s_price": ["price", "unit_price"]}
    )
    return out.withColumn("importance", F.round("importance", 6))


@query(
    "h05_expand_to_rows",
    sql("SELECT exp_code, layer, feature, round(imp, 6) AS importance FROM pred JOIN w USING (exp_code)", "cells", "scores", extra=INFORMED),
)
def expanded(spark, folder):
    out = metrics.expand_to_rows(predictions(spark, folder), price_importance(spark, folder), "importance")
    return out.select("exp_code", "layer", "feature", F.round("importance", 6).alias("importance"))


@query(
    "h06_validate",
    sql(
        f"""SELECT 'price' AS feature, round(avg(abs(truth - pred)), 4) AS mae, round({R2}, 6) AS r2, count(*) AS n_samples FROM (
        SELECT price AS truth, 1500.0 * quantity AS pred FROM rows WHERE price IS NOT NULL AND exp_code IN (SELECT exp_code FROM split WHERE split = 'test'))""",
        *VIEWS, extra={**ROWS, **SPLIT},
    ),
)
def validate(spark, folder):
    test = splits(spark, folder).where("split = 'test'").select("exp_code")
    stats = fitted(spark, folder, "price")
    held = rows(spark, folder).join(test, "exp_code", "left_semi").where("price IS NOT NULL")
    scaled = held.withColumns({"pred_price": stats["price"].forward(1500.0 * F.col("quantity")), "price": stats["price"].forward(F.col("price"))})
    return metrics.validate(scaled, ["price"], stats).withColumns({"mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query("h07_r2_gap", sql("SELECT feature, round(r2_inf - r2, 6) AS r2_gap FROM inf", "cells", "scores", extra=INFORMED))
def gap(spark, folder):
    weighted = metrics.expand_to_rows(predictions(spark, folder), price_importance(spark, folder), "importance")
    return metrics.informed_r2(weighted, "importance").select("feature", F.round("r2_gap", 6).alias("r2_gap"))


def training_rows(spark, folder):
    """Flagship: grid, positions, lags, train-only scaling and filled inputs in one plan."""
    stats = prep.fit_norm(
        train_rows(spark, folder), {"total": "standard", "quantity": "min_max"}, lagged={"prev_quantity": "quantity"}
    )
    base = prep.add_lags(rows(spark, folder), ["quantity"], k=1)
    ready = prep.apply_norm(prep.fill_inputs(base, ["total", "layer_pos", "prev_quantity"]), {k: stats[k] for k in ("total", "prev_quantity")})
    kept, _ = prep.drop_missing_targets(ready, ["price"])
    return kept.select("exp_code", "cell_idx", *[F.round(c, 6).alias(c) for c in ("total", "layer_pos", "prev_quantity")], "price")


query(
    "training_rows",
    sql(
        """SELECT exp_code, cell_idx, round((total - m) / (s + 1e-8), 6) AS total, round(layer_pos, 6) AS layer_pos,
        round((coalesce(CASE WHEN cell_idx >= 1 THEN prev ELSE quantity END, 0) - lo) / (hi - lo + 1e-8), 6) AS prev_quantity, price
        FROM (SELECT *, lag(quantity) OVER (PARTITION BY exp_code ORDER BY cell_idx) AS prev FROM rows), st WHERE price IS NOT NULL""",
        *VIEWS, extra=NORMED,
    ),
)(training_rows)
