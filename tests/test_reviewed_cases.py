"""Cases that once gave wrong answers: logs before proposals, own sizes, repeated cells, replays, infinities."""

import math

import numpy as np
import pytest
from conftest import rows

from runlattice.functions.quantiles import exact_quantiles
from runlattice.operators import asof, metrics, quality
from runlattice.operators import evidence as ev
from runlattice.plans import modelling
from runlattice.schema import Axis, Feature
from runlattice.streaming import updates as su

LOG = "exp_code string, seq long, iterator_code string, step_index int, param string, value double"
AXES = [Axis("n", "i", 10)]


def log(spark, *events):
    return spark.createDataFrame([("a", *e) for e in events], LOG)


@pytest.fixture(scope="module")
def exp(spark):
    return spark.createDataFrame([("a", 1.0, 12)], "exp_code string, p double, n int")


def test_proposals_meet_the_log_at_their_own_step(spark, exp):
    held = log(spark, (0, "i", 0, "p", 10.0), (1, "i", 5, "p", 20.0))
    new = log(spark, (100, "i", 2, "p", 10.0), (101, "i", 7, "p", 10.0))
    assert rows(asof.record_updates(exp, held, new, AXES, ["p"]).select("seq")) == [(101,)]
    # Once one is recorded it is in force, whatever the log says of later steps.
    new = log(spark, (100, "i", 2, "p", 11.0), (101, "i", 7, "p", 20.0), (102, "i", 8, "p", 20.0), (103, "i", 9, "p", 10.0))
    assert rows(asof.record_updates(exp, held, new, AXES, ["p"]).select("seq"), "seq") == [(100,), (101,), (103,)]


@pytest.mark.parametrize("mode", ["context", "row"])
def test_steps_past_the_declared_size(spark, exp, mode):
    ups = log(spark, (0, "i", 10, "p", 5.0), (1, "i", 12, "p", 9.0))
    got = rows(asof.effective_params(exp, ups, AXES, ["p"], mode).select("cell_idx", "p"), "cell_idx")
    assert got == [(i, 5.0 if i >= 10 else 1.0) for i in range(12)]
    assert rows(asof.params_at_last_row(exp, ups, AXES, ["p"]).select("p")) == [(5.0,)]
    assert rows(asof.params_at_step(exp, ups, AXES, ["p"], "i", 10).select("p")) == [(5.0,)]


def test_steps_past_the_own_size_make_no_cells(spark, exp):
    ups = log(spark, (0, "i", 2_000_000_000, "p", 5.0), (1, "i", 3, "p", 6.0))
    got = rows(asof.effective_params(exp, ups, AXES, ["p"]).select("cell_idx", "p"), "cell_idx")
    assert got == [(i, 6.0 if i >= 3 else 1.0) for i in range(12)]


def test_repeated_and_outlying_cells_count_once_or_never(spark):
    exps = spark.createDataFrame([("a", 2), ("b", 2)], "exp_code string, n int")
    values = spark.createDataFrame(
        [("a", "f", 0, 1.0), ("a", "f", 0, 2.0), ("b", "f", 0, 1.0), ("b", "f", 1, 1.0), ("b", "f", 7, 1.0)],
        "exp_code string, feature string, i int, value double",
    )
    axes = [Axis("n", "i", 10)]
    report = quality.completeness(exps, values, [Feature("f", 1)], axes)
    assert rows(report.select("exp_code", "actual", "ok"), "exp_code") == [("a", 1, False), ("b", 2, True)]
    assert rows(quality.incomplete(report)) == [("a", "f")]
    ranged = quality.complete_in_range(exps, values.where("feature = 'f'"), axes, "value")
    assert [bool(r[1]) for r in rows(ranged, "exp_code")] == [False, True]


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "splits")
    spark.createDataFrame([("x",), ("y",)], "exp_code string").coalesce(1).write.parquet(src)
    for check in ("one", "two"):  # a new checkpoint runs batch 0 again
        stream = spark.readStream.schema("exp_code string").parquet(src)
        su.grow_splits(spark, stream, out, str(tmp_path / check), "exp_code string, split string").awaitTermination()
        got = spark.read.option("recursiveFileLookup", True).parquet(out).select("exp_code", "split")
        assert rows(got, "exp_code") == [("x", "train"), ("y", "train")]


@pytest.mark.parametrize("odd", [math.inf, -math.inf, math.nan])
def test_quantiles_leave_out_what_is_not_finite(spark, odd):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, odd)], "v double")
    got = exact_quantiles(df, ["v"], [0.5], [0.5])["v"]
    assert (got["n"], got["min"], got["max"], got["q", 0.5], got["low", 0.5]) == (3, 1.0, 3.0, 2.0, 2.0)


def test_quantiles_of_a_range_beyond_doubles(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (5.0,), (1.7e308,)], "v double")
    got = exact_quantiles(df, ["v"], [], [0.5])["v"]
    assert got["low", 0.5] == 0.0


def test_rows_without_truth_or_prediction_count_for_nothing(spark):
    df = spark.createDataFrame([("f", 1.0, 1.0), ("f", 3.0, 2.0), ("f", None, 9.0), ("f", 50.0, None)], "feature string, truth double, pred double")
    assert rows(metrics.regression_metrics(df)) == [("f", 0.5, 0.5, 2)]


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 6])
def test_directions_are_spread_and_balanced(dim):
    n = ev.n_directions(dim) // 2 * 2
    d = ev.directions(dim, n)
    assert d.shape == (n, dim) and np.allclose(np.linalg.norm(d, axis=1), 1)
    assert np.allclose(d.mean(axis=0), 0, atol=1e-12)
    assert np.allclose(d.T @ d / n, np.eye(dim) / dim, atol=0.12)


@pytest.mark.parametrize("query", [modelling.extract, modelling.raw, modelling.derived])
def test_features_are_extracted_with_the_log(spark, sf, query, monkeypatch):
    logs, plain = [], modelling.features.extract
    monkeypatch.setattr(modelling.features, "extract", lambda exps, log, *rest, **more: logs.append(log) or plain(exps, log, *rest, **more))
    query(spark, sf)
    assert len(logs) == 1 and logs[0].count() == modelling.tb.updates(spark, sf).count() > 0


def test_an_update_shows_in_extracted_features(spark, sf, monkeypatch):
    key = modelling.tb.sized_experiments(spark, sf).where("n_layers > 2").first().exp_code
    before = {r.cell_idx: r.heat for r in modelling.extract(spark, sf).where(f"exp_code = {key}").collect()}
    new = spark.createDataFrame([(key, 1, "layer", 1, "total", 1000.0)], "exp_code long, seq long, iterator_code string, step_index int, param string, value double")
    monkeypatch.setattr(modelling.tb, "updates", lambda spark, folder: new)
    after = {r.cell_idx: r.heat for r in modelling.extract(spark, sf).where(f"exp_code = {key}").collect()}
    assert after == {i: h if i == 0 else pytest.approx(1 + 0.1 * i) for i, h in before.items()}
