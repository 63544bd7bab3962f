import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlattice.functions import blocked
from runlattice.operators import asof, grid, quality
from runlattice.schema import Axis, Feature, Param, find_axis, struct_of

AXES = [Axis("dim_1", "d1", 2), Axis("dim_2", "d2", 3)]
LOG = "exp_code string, seq long, iterator_code string, step_index int, param string, value double"


@pytest.fixture(scope="module")
def exp(spark):
    return spark.createDataFrame([("exp_001", 2.5, 2, 3)], "exp_code string, param_1 double, dim_1 int, dim_2 int")


def log(spark, *events):
    return spark.createDataFrame([("exp_001", i, *e) for i, e in enumerate(events)], LOG)


def test_export_of_mixed_depths(spark, exp):
    cells = grid.expand_domain(exp, AXES)
    deep = spark.createDataFrame([("exp_001", a, b, 10.0 * a + b) for a in range(2) for b in range(3)], "exp_code string, d1 int, d2 int, g double")
    mid = spark.createDataFrame([("exp_001", a, 100.0 + a) for a in range(2)], "exp_code string, d1 int, m double")
    top = spark.createDataFrame([("exp_001", 7.0)], "exp_code string, s double")
    out = grid.value_at(cells, deep, Feature("g", 2), AXES)
    out = grid.value_at(out, mid, Feature("m", 1), AXES)
    out = grid.with_positions(grid.value_at(out, top, Feature("s", 0), AXES), AXES)
    got = rows(out.select("d1", "d2", "param_1", "dim_1", "dim_2", "g", "m", "s", "d1_pos", "d2_pos"), "d1", "d2")
    assert got == [(i // 3, i % 3, 2.5, 2, 3, 10.0 * (i // 3) + i % 3, 100.0 + i // 3, 7.0, float(i // 3), (i % 3) / 2) for i in range(6)]


def test_no_axes_is_one_row_and_empty_axis_is_none(spark, exp):
    assert grid.expand_domain(exp, []).count() == 1
    assert grid.expand_domain(exp.withColumn("dim_2", F.lit(0)), AXES).count() == 0
    assert [r["cell_idx"] for r in grid.expand_domain(exp, AXES, start=2, stop=4).orderBy("cell_idx").collect()] == [2, 3]


def test_large_domain_is_cut_into_blocks(spark):
    axes = [Axis("n", "i", 10**9)]
    big = spark.createDataFrame([("a", 200_001), ("b", 3)], "exp_code string, n int")
    got = grid.expand_domain(big, axes).groupBy("exp_code").agg(F.count("*").alias("c"), F.max("i").alias("m"), F.sum("cell_idx").alias("s"))
    assert rows(got, "exp_code") == [("a", 200_001, 200_000, 200_001 * 200_000 // 2), ("b", 3, 2, 3)]


def test_update_named_by_dimension(spark, exp):
    ups = log(spark, ("dim_1", 1, "param_1", 9.0))
    got = rows(asof.effective_params(exp, ups, AXES, ["param_1"]).select("cell_idx", "param_1"), "cell_idx")
    assert [v for _, v in got] == [2.5] * 3 + [9.0] * 3


def test_two_rules_differ_on_an_inner_axis(spark, exp):
    ups = log(spark, ("d2", 1, "param_1", 9.0))
    context = rows(asof.effective_params(exp, ups, AXES, ["param_1"]).select("cell_idx", "param_1"), "cell_idx")
    row = rows(asof.effective_params(exp, ups, AXES, ["param_1"], "row").select("cell_idx", "param_1"), "cell_idx")
    assert [v for _, v in context] == [2.5, 9.0, 9.0, 2.5, 9.0, 9.0]
    assert [v for _, v in row] == [2.5, 9.0, 9.0, 9.0, 9.0, 9.0]


def test_log_order_beats_step_order_and_unconditional_applies(spark, exp):
    ups = log(spark, ("d2", 2, "param_1", 1.0), ("d2", 1, "param_1", 2.0), (None, None, "param_1", 3.0), ("d1", 1, "param_1", 4.0))
    got = rows(asof.effective_params(exp, ups, AXES, ["param_1"]).select("cell_idx", "param_1"), "cell_idx")
    assert [v for _, v in got] == [3.0, 3.0, 3.0, 4.0, 4.0, 4.0]


@pytest.mark.parametrize("part, block", [(asof.PART, asof.BLOCK), (8, 4)])
@pytest.mark.parametrize("mode", ["context", "row"])
def test_random_logs_against_a_loop(spark, monkeypatch, mode, part, block):
    monkeypatch.setattr(asof, "BLOCK", block)
    monkeypatch.setattr(asof, "PART", part)
    rng = random.Random(5)
    axes = [Axis("n0", "i0", 4), Axis("n1", "i1", 5)]
    exps, events = [], []
    for e in range(60):
        exps.append((f"e{e}", 0.5, -0.5, rng.randint(1, 4), rng.randint(1, 5)))
        for s in range(rng.randint(0, 8)):
            axis = rng.choice(["n0", "i0", "i1", "n1", None])
            events.append((f"e{e}", s, axis, rng.randint(0, 7) if axis else None, rng.choice(["p", "q"]), rng.random()))
    base = spark.createDataFrame(exps, "exp_code string, p double, q double, n0 int, n1 int")
    got = asof.effective_params(base, spark.createDataFrame(events, LOG), axes, ["p", "q"], mode).collect()
    assert len(got) == sum(x[3] * x[4] for x in exps)
    for r in got:
        want = {"p": 0.5, "q": -0.5}
        for _, _, axis, step, param, value in sorted((x for x in events if x[0] == r["exp_code"]), key=lambda x: x[1]):
            if axis is None:
                on = True
            elif mode == "context":
                on = (r["i0"] if axis in ("n0", "i0") else r["i1"]) >= step
            else:
                on = r["cell_idx"] >= step * (r["n1"] if axis in ("n0", "i0") else 1)
            if on:
                want[param] = value
        assert (r["p"], r["q"]) == (want["p"], want["q"])


def test_recorded_updates(spark, exp):
    empty = spark.createDataFrame([], LOG)
    same = log(spark, ("d1", 0, "param_1", 2.5), ("d1", 1, "param_1", 4.0), ("d1", 1, "param_1", 4.0))
    out = asof.record_updates(exp, empty, same, AXES, ["param_1"])
    assert rows(out.select("seq", "value")) == [(1, 4.0)]
    held = asof.record_updates(exp, log(spark, ("d1", 0, "param_1", 8.0)), same.where("seq = 0"), AXES, ["param_1"])
    assert rows(held.select("value")) == [(2.5,)]
    with pytest.raises(Exception, match="axis"):
        asof.record_updates(exp, empty, log(spark, ("d1", 0, "dim_1", 1.0)), AXES, ["param_1"]).collect()
    with pytest.raises(ValueError):
        asof.params_at_step(exp, empty, AXES, ["param_1"], "d1", None)


def test_recorded_updates_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK", 4)
    own = random.Random(9)
    sizes, held, new = {f"e{e}": (own.randint(1, 4), own.randint(1, 5)) for e in range(40)}, [], []
    for e in sizes:
        for s in range(own.randint(0, 6)):
            axis = own.choice(["n0", "i1", None])
            held.append((e, s, axis, own.randint(0, 5) if axis else None, own.choice(["p", "q"]), float(own.randint(0, 2))))
        steps = sorted(own.randint(0, 5) for _ in range(own.randint(0, 9)))
        new += [(e, 100 + i, "i0", s, own.choice(["p", "q"]), float(own.randint(0, 2))) for i, s in enumerate(steps)]
    want = []
    for e, (_, n1) in sizes.items():
        known = [x for x in held if x[0] == e]

        def at(x):
            return 0 if x[2] is None else x[3] * (n1 if x[2] in ("n0", "i0") else 1)

        for x in sorted(p for p in new if p[0] == e):
            before = 0.0
            for y in sorted(known):
                before = y[5] if y[4] == x[4] and at(y) <= at(x) else before
            if before != x[5]:
                known.append(x)
                want.append(x)
    base = spark.createDataFrame([(e, 0.0, 0.0, *n) for e, n in sizes.items()], "exp_code string, p double, q double, n0 int, n1 int")
    got = asof.record_updates(base, spark.createDataFrame(held, LOG), spark.createDataFrame(new, LOG), [Axis("n0", "i0", 4), Axis("n1", "i1", 5)], ["p", "q"])
    assert sorted(rows(got)) == sorted(want) and len(want) > 50


def test_refused_and_sanitised_updates(spark, exp):
    empty, spec = spark.createDataFrame([], LOG), [Param("param_1", "real", 0, 10, digits=1)]
    out = asof.record_updates(exp, empty, log(spark, ("d1", 0, "param_1", 3.14159), ("d1", 1, "param_1", 3.14159)), AXES, ["param_1"], spec)
    assert rows(out.select("seq", "value")) == [(0, 3.1)]
    for events, why in (
        ([("d1", 1, "param_1", 1.0), ("d1", 0, "param_1", 2.0)], "step order"), ([(None, 1, "param_1", 1.0)], "axis and step"),
        ([("d1", None, "param_1", 1.0)], "axis and step"), ([("d1", 0, "param_1", 99.0)], "above_max"),
    ):
        with pytest.raises(Exception, match=why):
            asof.record_updates(exp, empty, log(spark, *events), AXES, ["param_1"], spec).collect()


def test_dense_round_trip_and_last_duplicate(spark, exp):
    cells = spark.createDataFrame([("exp_001", 0, 1, 1.0, 0), ("exp_001", 0, 1, 2.0, 1), ("exp_001", 1, 2, 5.0, 0)], "exp_code string, d1 int, d2 int, v double, seq int")
    full = grid.fill_grid(cells, exp, AXES, "v", "seq")
    dense = grid.to_dense(full, AXES, "v", chunk=4)
    back = rows(grid.to_sparse(dense, AXES, "v", chunk=4).select("cell_idx", "d1", "d2", "v"), "cell_idx")
    assert back == [(0, 0, 0, None), (1, 0, 1, 2.0), (2, 0, 2, None), (3, 1, 0, None), (4, 1, 1, None), (5, 1, 2, 5.0)]
    bad = spark.createDataFrame([("exp_001", 2, 0, 1.0)], "exp_code string, d1 int, d2 int, v double")
    assert grid.out_of_bounds(bad, exp, AXES).count() == 1


def test_blocked_lag_and_positions_cross_block_ends(spark):
    df = spark.range(50).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 10).alias("v"))
    got = rows(blocked.lag_dense(df, ["k"], "i", {"p": "v"}, 3, block=7).select("i", "p"), "i")
    assert got == [(i, None if i < 3 else (i - 3) * 10) for i in range(50)]
    sparse = df.where("i % 3 <> 1")
    kept = [i for i in range(50) if i % 3 != 1]
    got = rows(blocked.lag_sparse(sparse, ["k"], "i", "v", "p", block=4).select("i", "p"), "i")
    assert got == [(i, None if n == 0 else kept[n - 1] * 10) for n, i in enumerate(kept)]
    two = spark.createDataFrame([(a, b) for a in range(5) for b in range(20)], "a long, b long")
    got = rows(blocked.positions(two, ["a", "b"], block=3).select("a", "b", "pos"), "a", "b")
    assert [p for *_, p in got] == list(range(100))


def test_schema_declarations():
    with pytest.raises(ValueError):
        Param("x", "category")
    with pytest.raises(ValueError):
        Param("x", lo=2, hi=1)
    with pytest.raises(ValueError):
        find_axis(AXES, "none")
    fields = struct_of([Param("x", lo=0, hi=1)], AXES)
    assert fields["x"].metadata["hi"] == 1 and fields["dim_1"].metadata["hi"] == 2


def test_validation_and_coercion(spark):
    spec = [Param("x", "real", 0, 10), Param("n", "int", 1, 5), Param("on", "bool"), Param("c", "category", vocab=("A", "B"))]
    raw = spark.createDataFrame([("e", 1.23456, 2.5, 0.5, "A"), ("f", 11.0, 3.5, 0.4, "A")], "exp_code string, x double, n double, on double, c string")
    out = quality.sanitize(raw, spec, check=False)
    assert rows(out, "exp_code") == [("e", 1.235, 2, True, "A"), ("f", 11.0, 4, False, "A")]
    assert rows(quality.violations(out, spec).drop("found")) == [("f", "x", "above_max")]
    with pytest.raises(Exception, match="invalid parameter"):
        quality.sanitize(raw, spec).collect()
    with pytest.raises(KeyError):
        quality.sanitize(raw.withColumn("other", F.lit(1)), spec)


def test_completeness_counts_nan_as_missing(spark, exp):
    vals = spark.createDataFrame([("exp_001", "g", 1.0)] * 5 + [("exp_001", "g", float("nan")), ("exp_001", "s", 7.0)], "exp_code string, feature string, value double")
    report = quality.completeness(exp, vals, [Feature("g", 2), Feature("s", 0), Feature("none", 1)], AXES)
    assert rows(report.drop("exp_code"), "feature") == [("g", 6, 5, 1, False), ("none", 2, 0, 0, False), ("s", 1, 1, 0, True)]
