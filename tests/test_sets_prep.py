import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlattice.functions.quantiles import exact_quantiles
from runlattice.operators import prep, sets
from runlattice.schema import Axis, Param


@pytest.fixture(scope="module")
def exps(spark):
    data = [("e1", 0, 1, "discovery"), ("e2", 1, 5, "discovery"), ("e3", 2, 9, "exploration"), ("e4", 3, 3, None), ("e5", 4, 7, "test")]
    return spark.createDataFrame(data, "exp_code string, exp_seq long, p int, dataset_code string")


def codes(df, *order):
    return [r["exp_code"] for r in df.orderBy(*order).collect()]


def test_select(exps):
    assert codes(sets.select(exps, F.col("dataset_code") == "discovery"), "exp_seq") == ["e1", "e2"]
    assert codes(sets.select(exps, F.col("p") >= 5), "exp_seq") == ["e2", "e3", "e5"]
    assert codes(sets.select(exps, F.col("dataset_code").isNotNull()), "exp_seq") == ["e1", "e2", "e3", "e5"]
    assert rows(sets.dataset_codes(exps), "first_seen") == [("discovery", 0), ("exploration", 2), ("test", 4)]


def make_set(spark, code, members, ordered=True):
    return spark.createDataFrame([(code, ordered, i, m) for i, m in enumerate(members)], "set_code string, ordered boolean, pos long, exp_code string")


def test_windows_and_fits(spark):
    run = make_set(spark, "E", ["e1", "e2", "e3", "e4", "e5"])
    base = make_set(spark, "D", ["d1", "d2", "d3"], False)
    assert codes(sets.window(run, 2), "pos") == ["e1", "e2"]
    assert codes(sets.fit_at(run, 0), "pos") == []
    with pytest.raises(Exception, match="not an ordered set"):
        sets.window(base, 2).collect()
    assert codes(sets.fit_codes([base, sets.window(run, 3)]), "pos") == ["d1", "d2", "d3", "e1", "e2", "e3"]
    a, b = make_set(spark, "a", ["x1", "x2"]), make_set(spark, "b", ["x2", "x3"])
    assert codes(sets.fit_codes([a, b]), "pos") == ["x1", "x2", "x3"]


def test_append_is_idempotent_and_checks_the_set(spark):
    run = make_set(spark, "E", ["e1", "e2"])
    more = spark.createDataFrame([("E", "e2", 5), ("E", "e9", 6)], "set_code string, exp_code string, exp_seq long")
    assert codes(sets.append_to_sets(run, more), "pos") == ["e1", "e2", "e9"]
    with pytest.raises(Exception, match="unknown set"):
        sets.append_to_sets(run, more.withColumn("set_code", F.lit("Z"))).collect()


def test_split_sizes_round_half_even(spark):
    ids = spark.range(50).select(F.concat(F.lit("c"), "id").alias("exp_code"))
    sizes = dict(rows(sets.split_sizes(sets.split(ids, val=0.25, test=0.25, seed=1))))
    assert sizes == {"train": 25, "validation": 13, "test": 12}  # 12.5 and 12.67 rounded
    preset = ids.limit(3).withColumn("split", F.lit("test"))
    assert sets.split(ids, preset=preset).count() == 3
    again = sets.split(ids, 0.25, 0.25, 1).exceptAll(sets.split(ids, 0.25, 0.25, 1))
    assert again.isEmpty()


def test_folds(spark):
    ten = spark.range(10).select(F.col("id").cast("string").alias("exp_code"))
    sizes = sorted(r["count"] for r in sets.folds(ten, 3).groupBy("fold").count().collect())
    assert sizes == [3, 3, 4]
    assert sets.folds(ten.limit(3), 99).select("fold").distinct().count() == 3
    assert sets.folds(ten.limit(0), 4).count() == 0
    assert sets.folds(ten, 1).select("fold").distinct().count() == 2


def test_split_by_tag_needs_a_match(exps):
    with pytest.raises(ValueError):
        sets.split_by_tag(exps, {"train": ["discovery"], "test": ["nothing"]})


def test_provenance_keeps_what_it_does_not_know(spark):
    df = spark.createDataFrame(
        [("a", '{"source":"sobol_step","seed":3,"kappa":0.5,"origin":["E1",2]}'), ("b", '{"source":"odd","origin":[1,2,3]}'), ("c", None)],
        "exp_code string, config_snapshot string",
    )
    got = {r["exp_code"]: r for r in sets.parse_provenance(df).collect()}
    assert (got["a"]["source"], got["a"]["seed"], got["a"]["origin_set"], got["a"]["origin_pos"]) == ("sobol_step", 3, "E1", 2)
    assert got["a"]["settings"] == {"kappa": "0.5"}
    assert got["b"]["source"] is None and got["b"]["settings"]["source"] == "odd" and "origin" in got["b"]["settings"]
    run = make_set(spark, "E1", ["x0", "x1", "x2"])
    fits = sets.fit_from_provenance(sets.parse_provenance(df), run)
    assert rows(fits) == [("a", "E1", 2)]
    assert codes(sets.fit_members(fits, run, "a"), "pos") == ["x0", "x1"]


def values(spark, *v):
    return spark.createDataFrame([(float(x),) for x in v], "x double")


def test_statistics(spark):
    s = prep.fit_norm(values(spark, 1, 2, 3, 4, 5), {"x": "standard"})["x"]
    assert s.mean == 3 and math.isclose(s.std, math.sqrt(2))
    s = prep.fit_norm(values(spark, 1, 3, 5), {"x": "min_max"})["x"]
    assert (s.min, s.max) == (1, 5)
    assert prep.fit_norm(values(spark, 1, 2, 3, 4, 5), {"x": "robust"})["x"].median == 3
    s = prep.fit_norm(values(spark, 1, 2, 3, 10), {"x": "robust"})["x"]
    assert (s.median, s.q1, s.q3) == (2, 1.75, 4.75)
    assert prep.fit_norm(values(spark, float("nan")), {"x": "standard"}) == {}
    with pytest.raises(ValueError):
        prep.fit_norm(values(spark, 1), {"x": "other"})


def test_leak_free(spark):
    rows_ = spark.createDataFrame([("A", 2.0), ("B", 4.0), ("C", 1000.0), ("D", 2000.0)], "exp_code string, x double")
    s = prep.fit_norm(rows_.where("exp_code IN ('A', 'B')"), {"x": "standard"})["x"]
    assert (s.mean, s.std) == (3.0, 1.0)
    s = prep.fit_norm(rows_.where("exp_code <> 'D'"), {"x": "standard"})["x"]
    assert math.isclose(s.mean, 1006 / 3)


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_on_clumped_values(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    v = np.concatenate([np.full(3000, 5.0), rng.lognormal(0, 4, 3000), -rng.random(997)])
    got = exact_quantiles(values(spark, *v), ["x"], [0.25, 0.5, 0.9], [0.5])["x"]
    for p in (0.25, 0.5, 0.9):
        assert math.isclose(got[("q", p)], np.quantile(v, p), rel_tol=1e-12)
    assert got[("low", 0.5)] == np.sort(v)[(len(v) - 1) // 2]


def test_round_trips_and_flat_columns(spark):
    df = values(spark, -1, 0, 2.5, 4)
    for s in (
        prep.Stats("x", "standard", mean=3.0, std=2.0),
        prep.Stats("x", "min_max", min=-1.0, max=4.0),
        prep.Stats("x", "robust", median=2.0, q1=1.0, q3=5.0),
    ):
        back = prep.reverse_norm(prep.apply_norm(df, {"x": s}), {"x": s})
        assert all(math.isclose(a[0], b[0], abs_tol=1e-6) for a, b in zip(rows(back, "x"), rows(df, "x")))
    flat = prep.Stats("x", "min_max", min=2.0, max=2.0)
    assert {r[0] for r in rows(prep.apply_norm(df, {"x": flat}))} == {0.0}
    assert {r[0] for r in rows(prep.reverse_norm(df, {"x": flat}))} == {2.0}
    stats = {"x": prep.Stats("x", "robust", median=2.0, q1=1.0, q3=5.0)}
    assert prep.stats_from_table(prep.stats_table(spark, stats)) == stats


def test_lags(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([10, 20, 30])] + [("b", i, v) for i, v in enumerate([100, 200])], "exp_code string, cell_idx long, x int")
    assert [r[0] for r in rows(prep.add_lags(df, ["x"]).orderBy("exp_code", "cell_idx").select("prev_x"))] == [10, 10, 20, 100, 100]
    four = spark.createDataFrame([("a", i, i + 1) for i in range(4)], "exp_code string, cell_idx long, x int")
    assert [r[0] for r in rows(prep.add_lags(four, ["x"], 2).orderBy("cell_idx").select("prev_x"))] == [1, 2, 1, 2]


def test_categories(spark):
    df = spark.createDataFrame([("A",), ("B",), ("?",)], "c string")
    assert [r[0] for r in rows(df.select(prep.category_index(F.col("c"), ["B", "A"])))] == [0, 1, 0]
    with pytest.raises(Exception, match="unknown category"):
        df.select(prep.category_index(F.col("c"), ["B", "A"], "error")).collect()
    idx = spark.createDataFrame([(9.0,), (-3.0,), (0.6,)], "i double")
    assert [r[0] for r in rows(idx.select(prep.category_label(F.col("i"), ["A", "B"])))] == ["B", "A", "B"]


def test_unit_frames(spark):
    df = values(spark, 2, 5)
    assert [r[0] for r in rows(df.select(prep.to_unit(F.col("x"), F.lit(0.0), F.lit(10.0))))] == [0.2, 0.5]
    assert [r[0] for r in rows(df.select(prep.to_unit(F.col("x"), F.lit(2.0), F.lit(2.0))))] == [0.0, 3.0]
    assert [r[0] for r in rows(df.select(prep.value_to_unit(F.col("x"), F.lit(2.0), F.lit(2.0))))] == [0.5, 0.5]


def test_dropped_targets_are_counted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 3.0)], "a double, b double")
    kept, seen = prep.drop_missing_targets(df, ["a", "b"])
    assert kept.count() == 1 and seen.get == {"n_rows": 3, "n_dropped": 2}


def test_sequences_are_padded(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 1, 2.0, None), ("b", 0, 3.0, 6.0)], "cand_id string, i int, x double, y double")
    got = {r["cand_id"]: r for r in prep.sequence_batch(df, ["cand_id"], Axis("n", "i", 3), ["x"], ["y"]).collect()}
    assert list(got["a"]["mask"]) == [1, 0, 0] and list(got["b"]["mask"]) == [1, 0, 0]
    assert [s["x"] for s in got["b"]["steps"]] == [3.0, 0.0, 0.0]


def test_calibration_arrays_strict(spark):
    axes = [Axis("n", "i", 3)]
    exps = spark.createDataFrame([("a", 1.0, 2), ("b", 2.0, 2)], "exp_code string, p double, n int")
    none = spark.createDataFrame([("a", 0, "i", 1, "p", 9.0)], "exp_code string, seq long, iterator_code string, step_index int, param string, value double")
    scores = spark.createDataFrame([("a", "s", 0.5)], "exp_code string, perf_code string, score double")
    out = prep.calibration_arrays(exps, none, scores, axes, ["p"], ["s"], strict=False)
    assert rows(out) == [("a", 9.0, 0.5)]
    with pytest.raises(Exception, match="missing scores"):
        prep.calibration_arrays(exps, none, scores, axes, ["p"], ["s"]).collect()


def test_decode_skips_context(spark):
    df = spark.createDataFrame([(0.5, 1.2, 0.7)], "x double, c double, h double")
    spec = [Param("x", "int", 0, 10), Param("c", "category", vocab=("A", "B")), Param("h")]
    stats = {"x": prep.Stats("x", "min_max", min=0.0, max=9.0)}
    assert rows(prep.decode(df, spec, stats, ["h"])) == [(4, "B")]
