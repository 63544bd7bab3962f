import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlattice.operators import cv, features, grid, metrics, models, prep, report, scoring, sensitivity
from runlattice.schema import Axis

AXES = [Axis("n_layers", "d1", 5), Axis("n_segments", "d2", 5)]
LOG = "exp_code string, seq long, iterator_code string, step_index int, param string, value double"


def test_workflow_scores(spark):
    exps = spark.createDataFrame([(f"exp_00{i + 1}", i + 1.0, i + 2, 2, 3) for i in range(3)], "exp_code string, p1 double, p2 int, n_layers int, n_segments int")
    none = spark.createDataFrame([], LOG)
    d1, d2 = F.col("d1"), F.col("d2")
    feats = features.extract(exps, none, AXES, ["p1"], outputs={"f1": F.col("p1") + 0.1 * d1 + 0.01 * d2, "f2": 0.5 * F.col("p1") - 0.05 * d1})
    cells = feats.join(exps.select("exp_code", "p1"), "exp_code")
    target = 1.5 * F.col("p1")
    out = scoring.evaluate(
        cells, {"performance_1": (["f1"], 1 - F.abs(F.col("f1") - target) / target), "performance_2": (["f2"], 1 - F.abs(F.col("f2") - 1))}
    )
    got = {(r["exp_code"], r["perf_code"]): r["score"] for r in out.collect()}
    want = {"exp_001": (0.706667, 0.475), "exp_002": (0.686667, 0.975), "exp_003": (0.68, 0.525)}
    for code, (a, b) in want.items():
        assert math.isclose(got[(code, "performance_1")], a, abs_tol=1e-6) and math.isclose(got[(code, "performance_2")], b, abs_tol=1e-6)


def test_combined_score(spark):
    def one(*scores, w={"a": 1.0, "b": 1.0, "c": 2.0}):
        df = spark.createDataFrame([("e", p, s) for p, s in scores], "exp_code string, perf_code string, score double")
        return scoring.combined_score(df, w).first()["combined"]

    assert one(("a", 0.5), ("b", 0.5), ("c", 1.0)) == 0.75
    assert one(("a", 0.5), ("b", 0.5)) == 0.5 and one(("a", 0.5), ("b", 0.5), ("c", None)) == 0.5
    assert one(("a", 0.5), ("other", 1.0)) == 0.5
    assert one(("a", 0.5), w={"a": 0.0}) == 0.0


def test_missing_cells(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "exp_code string, f double")
    per = scoring.score_experiments(scoring.score_rows(df, ["f"], F.col("f")))
    assert dict(rows(per)) == {"a": 1.0, "b": None}
    batch = scoring.score_candidates(df.withColumnRenamed("exp_code", "cand_id"), ["f"], F.col("f"))
    assert dict(rows(batch)) == {"a": 0.0, "b": 0.0}
    assert dict(rows(scoring.aggregate_then_score(df, ["f"], "sum", F.col("f") / 2))) == {"a": 0.5, "b": None}


def test_evaluation_skips(spark):
    cells = spark.createDataFrame([("a", 0.4, None), ("b", 0.6, 1.0)], "exp_code string, temp double, flow double")
    scorers = {"s_temp": (["temp"], F.col("temp")), "s_flow": (["flow"], F.col("flow"))}
    stored = spark.createDataFrame([("a", "s_temp", 0.9)], "exp_code string, perf_code string, score double")
    assert rows(scoring.evaluate(cells, scorers, stored), "exp_code", "perf_code") == [("a", "s_temp", 0.9), ("b", "s_flow", 1.0), ("b", "s_temp", 0.6)]
    assert rows(scoring.evaluate(cells, scorers, stored, recompute=True, feature="TEM"), "exp_code") == [("a", "s_temp", 0.4), ("b", "s_temp", 0.6)]


def test_importance(spark):
    def weights(*s):
        df = spark.createDataFrame([("p", v) for v in s], "perf_code string, score double")
        return [r["importance"] for r in metrics.importance(df).orderBy("score").collect()]

    assert [round(w, 6) for w in weights(0.2, 0.5, 0.8)] == [0.345639, 0.55, 0.754361]
    assert [round(w, 9) for w in weights(0.5, 0.5, 0.5)] == [0.55] * 3


def test_r2_inf(spark):
    df = spark.createDataFrame([("f", float(i), i + 0.1 * (i % 3), 2.0) for i in range(9)], "feature string, truth double, pred double, w double")
    r = metrics.informed_r2(df, "w").first()
    assert math.isclose(r["r2"], r["r2_inf"]) and abs(r["r2_gap"]) < 1e-12
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0)], "feature string, truth double, pred double")
    assert dict(rows(metrics.regression_metrics(flat).select("feature", "r2"))) == {"a": 1.0, "b": 0.0}
    far = spark.createDataFrame([("f", 1e9 + i, 1e9 + i + 0.5) for i in range(10)], "feature string, truth double, pred double")
    assert math.isclose(metrics.regression_metrics(far).first()["r2"], 1 - 2.5 / 82.5, rel_tol=1e-9)


def test_user_function_must_return_numbers(spark):
    exps = spark.createDataFrame([("a", 1.0, 1, 1)], "exp_code string, p1 double, n_layers int, n_segments int")
    none = spark.createDataFrame([], LOG)
    ok = features.extract(exps, none, AXES, ["p1"], function=lambda b: b.assign(f=b.p1 * 2), names=["f"])
    assert rows(ok.select("f")) == [(2.0,)]
    with pytest.raises(Exception, match="not a number"):
        features.extract(exps, none, AXES, ["p1"], function=lambda b: b.assign(f="x"), names=["f"]).collect()
    with pytest.raises(TypeError):
        features.extract(exps, none, AXES, ["p1"], outputs={"f": F.lit("x")})


def test_pending_models(spark):
    exps = spark.createDataFrame([("a",), ("b",)], "exp_code string")
    done = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f")], "exp_code string, feature string")
    assert rows(features.pending(exps, done, ["f", "g"]), "feature") == [("b", "f"), ("b", "g")]
    assert features.pending(exps, done, ["f", "g"], recompute=True).count() == 4
    assert rows(features.pending(exps, done, ["f", "g"], only="G")) == [("b", "g")]


def line(spark, n=40):
    return spark.createDataFrame(
        [(f"e{i // 2}", i % 2, float(i), float((i * 7) % 11), 3.0 + 2.0 * i - 0.5 * ((i * 7) % 11)) for i in range(n)],
        "exp_code string, cell_idx long, a double, b double, y double",
    )


def test_cross_validation_of_an_exact_line(spark):
    data = line(spark)
    folds = data.select("exp_code").distinct().withColumn("fold", F.substring("exp_code", 2, 3).cast("int") % 4)
    out = cv.cross_validate(data, folds, ["a", "b"], ["y"], k=4)
    assert out.count() == 20 and out.agg(F.max("mae")).first()[0] < 1e-8
    with pytest.raises(ValueError):
        cv.cross_validate(data, folds, ["a"], ["y"], k=1)
    with pytest.raises(ValueError):
        cv.cross_validate(data, folds.limit(1), ["a"], ["y"])


def test_held_out_models_of_any_kind(spark):
    data = line(spark)
    folds = data.select("exp_code").distinct().withColumn("fold", F.substring("exp_code", 2, 3).cast("int") % 4)
    chain = [
        models.ModelSpec("z", ("a",), ("z",), formula={"z": F.col("a") * 2}),
        models.ModelSpec("y", ("z", "b"), ("y",)),
    ]
    out = cv.held_out(data.withColumn("z", F.col("a") * 2).withColumn("fold", F.lit(9)), folds, chain, {"b": "standard", "y": "standard"}, together=2)
    assert out.count() == 40 and {r.fold for r in out.select("fold").distinct().collect()} == {0, 1, 2, 3}
    assert cv.experiment_errors(out, ["y"]).agg(F.max("mae")).first()[0] < 1e-4
    # A tree knows an experiment's own level only if it has seen it.
    own = data.withColumn("y", F.when(F.col("exp_code") == "e7", 1000.0).otherwise(1.0))
    tree = [models.ModelSpec("y", ("a",), ("y",), kind="gbt", options={"maxIter": 1, "maxDepth": 5})]
    seen = {r.exp_code: r.mae for r in cv.experiment_errors(cv.held_out(own, folds, tree), ["y"]).collect()}
    assert seen["e7"] == 999.0 and len(seen) == 20
    for some in (folds.where("fold = 1"), folds.limit(0), folds.withColumn("fold", F.lit(None).cast("int"))):
        with pytest.raises(ValueError):
            cv.held_out(data, some, tree)
    # Rows without a fold take no part; a missing target is no pair.
    part = cv.held_out(own.withColumn("y", F.when(F.col("a") > 0, F.col("y"))), folds.where("exp_code <> 'e3'"), tree)
    counts = {r.exp_code: r.n_samples for r in cv.experiment_errors(part, ["y"]).collect()}
    assert "e3" not in counts and counts["e0"] == 1 and counts["e1"] == 2


def test_diagnosis(spark):
    errors = spark.createDataFrame([(c, "f", e) for c, e in zip("abcd", (1.0, 1.0, 0.0, 0.0))], "exp_code string, feature string, mae double")
    cover = spark.createDataFrame(list(zip("abcd", (0.9, 0.1, 0.9, 0.1))), "exp_code string, coverage double")
    out = cv.diagnose(errors, cover)
    assert [r["label"] for r in out.orderBy("exp_code").collect()] == ["model_problem", "under_explored", "trustworthy", "sparse_ok"]
    two = cv.diagnose(errors.withColumn("mae", F.when(F.col("exp_code") == "a", 0.4).otherwise(0.6)).where("exp_code < 'c'"), cover.withColumn("coverage", F.when(F.col("exp_code") == "a", 0.9).otherwise(0.2)), error_threshold=0.5, coverage_threshold=0.5)
    assert [r["label"] for r in two.orderBy("exp_code").collect()] == ["trustworthy", "under_explored"]
    assert sum(r["n"] for r in cv.label_summary(out).collect()) == 4


def test_sobol_indices_of_a_linear_model(spark):
    base = spark.range(4096).select(F.col("id"))
    base = base.withColumns({f"{m}{j}": sensitivity.hashed_unit("id", f"{m}{j}") for m in "ab" for j in range(2)})
    pts = sensitivity.evaluate(sensitivity.saltelli(base, "id", ["a0", "a1"], ["b0", "b1"], ["x", "z"]), {"y": 3 * F.col("x") + F.col("z"), "c": F.lit(1.0)})
    out = {(r["output"], r["input"]): r for r in sensitivity.sobol_indices(pts, "id", ["x", "z"], ["y", "c"], replicates=20).collect()}
    assert abs(out[("y", "x")]["s1"] - 0.9) < 0.05 and abs(out[("y", "z")]["st"] - 0.1) < 0.03
    assert 0 < out[("y", "x")]["st_conf"] < 0.1 and out[("c", "x")]["s1"] == 0
    with pytest.raises(Exception, match="no value"):
        sensitivity.evaluate(pts, {"q": F.lit(None).cast("double")}).collect()


def test_morris_of_a_linear_model(spark):
    pts = sensitivity.evaluate(sensitivity.morris_design(spark.range(50), "id", ["x", "z"]), {"y": 3 * F.col("x") - F.col("z")})
    assert pts.agg(F.min("x"), F.max("x")).first() == (0.0, 1.0)
    out = {r["input"]: r for r in sensitivity.morris_indices(pts, "id", ["y"]).collect()}
    assert math.isclose(out["x"]["mu_star"], 3) and math.isclose(out["z"]["mu"], -1) and out["x"]["sigma"] < 1e-9


def fitted(spark):
    data = line(spark)
    x = prep.fit_norm(data, {"a": "standard", "b": "min_max"})
    y = prep.fit_norm(data, {"y": "standard"}, side="y")
    first = models.ModelSpec("one", ("a", "b"), ("y",))
    second = models.ModelSpec("two", ("y", "a"), ("z",))
    train = data.withColumn("z", F.col("y") * 2 + F.col("a"))
    return models.fit([second, first], train, x, y), train


def test_models_in_order_and_bundle(spark, tmp_path):
    model, train = fitted(spark)
    assert [s.name for s in model.specs] == ["one", "two"] and model.inputs == ["a", "b"]
    out = models.predict(train, model)
    assert out.agg(F.max(F.abs(F.col("pred_y") - F.col("y")))).first()[0] < 1e-4
    assert out.agg(F.max(F.abs(F.col("pred_z") - F.col("z")))).first()[0] < 1e-3
    models.save_bundle(model, str(tmp_path / "bundle"), spark, train)
    bundle = models.load_bundle(str(tmp_path / "bundle"), spark)
    got = models.bundle_predict(train.select("exp_code", "a", "b"), bundle)
    assert got.columns == ["exp_code", "y", "z"]
    with pytest.raises(ValueError, match="unknown parameter"):
        models.bundle_predict(train, bundle)
    assert models.bundle_predict(train.select("exp_code", "a"), bundle).count() == 40
    with pytest.raises(ValueError):
        models.fit(model.specs, train.limit(0), {}, {})
    with pytest.raises(ValueError, match="circle"):
        models.in_order([models.ModelSpec("p", ("v",), ("u",)), models.ModelSpec("q", ("u",), ("v",))])


def test_categories_at_inference(spark):
    data = spark.createDataFrame([("a", c, float(i), i + (5.0 if c == "B" else 0.0)) for i, c in enumerate("ABABAB")], "exp_code string, c string, x double, y double")
    model = models.fit([models.ModelSpec("m", ("c", "x"), ("y",))], data, {}, {}, {"c": ["A", "B"]})
    assert models.bundle_predict(data.select("exp_code", "c", "x"), model).count() == 6
    with pytest.raises(Exception, match="unknown category"):
        models.bundle_predict(data.select("exp_code", F.lit("Z").alias("c"), "x"), model).collect()


def test_residual_correction(spark):
    model, train = fitted(spark)
    one = train.where("exp_code = 'e0'").select("a", "b").limit(1)
    shifted = spark.range(30).select(F.lit("n").alias("exp_code"), F.col("id").alias("cell_idx"), F.col("id").cast("double").alias("a"), ((F.col("id") * 5) % 7).cast("double").alias("b"))
    shifted = shifted.withColumn("y", 3 + 2 * F.col("a") - 0.5 * F.col("b") + 1.5).withColumn("z", F.lit(0.0))
    fix = models.fit_residual(shifted, model, 0, 20)
    got = models.predict_corrected(shifted, model, fix)
    assert got.agg(F.max(F.abs(F.col("pred_y") - F.col("y")))).first()[0] < 1e-2
    for start, stop in ((-1, 5), (40, 50), (5, 5), (0, 99)):
        with pytest.raises(ValueError):
            models.fit_residual(shifted, model, start, stop)
    assert one.count() == 1


def test_overlapping_batches(spark):
    cells = spark.range(10).select(F.lit("e").alias("exp_code"), F.col("id").alias("cell_idx"))
    got = rows(models.predict_range(cells, lambda d: d.withColumn("p", F.col("batch_id")), ["p"], 0, 10, 4, 1).select("cell_idx", "p"), "cell_idx")
    assert [p for _, p in got] == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]
    for args in ((0, 10, 0, 0), (0, 10, 4, -1), (0, 10, 4, 4)):
        with pytest.raises(ValueError):
            models.batched_cells(cells, *args)


def test_report_ties_and_nearest(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 2.0)], "x int, y int, v double")
    assert rows(report.grid_optima(g, "x", "y", {"v": F.col("v")})) == [("v", 0, 1, 3.0)]
    assert rows(report.slice_nearest(g, "x", 0.5), "y") == [(0, 0, 1.0), (0, 1, 3.0)]


def test_grid_depth(spark):
    exps = spark.createDataFrame([("a", 2, 3)], "exp_code string, n_layers int, n_segments int")
    assert grid.expand_domain(exps, AXES, depth=1).count() == 2
