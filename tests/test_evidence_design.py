import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from runlattice.functions import blocks
from runlattice.operators import acquire, design, evidence_wide, prep
from runlattice.operators import evidence as ev
from runlattice.schema import Axis, Param


def kernel_df(spark, points, weights=None):
    d = len(points[0])
    w = weights or [1.0] * len(points)
    return spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(points, w)], ", ".join([f"z{i} double" for i in range(d)]) + ", w double")


def closed_form(w, sigma):
    return sigma * math.sqrt(2 * math.pi) * sum((-1) ** (n + 1) * w**n / math.sqrt(n) for n in range(1, 400))


@pytest.mark.parametrize("w,shell", [(0.3, 0.03111245), (0.5, 0.04639710), (0.8, 0.06431893)])
def test_one_kernel_in_one_dimension(spark, w, shell):
    df = kernel_df(spark, [[0.5]], [w])
    assert math.isclose(ev.fit_evidence(df, ["z0"], 0.05).integral(), shell, rel_tol=1e-6)
    assert math.isclose(shell, closed_form(w, 0.05), rel_tol=5e-2)


def test_cube_estimator_against_closed_form():
    # A candidate into empty space: the probes alone.
    offsets, weights = ev.cube_probes(1, 0.05, 16384, box=6.0)
    rho = 0.5 * np.exp(-(offsets[:, 0] ** 2) / (2 * 0.05**2))
    assert math.isclose(0.5 * (weights / (1 + rho)).sum(), closed_form(0.5, 0.05), rel_tol=1e-4)


def test_boundary_halves_the_cube_integral(spark):
    half = ev.fit_evidence(kernel_df(spark, [[0.0]]), ["z0"], 0.05, estimator="cube", n_samples=512).integral()
    full = ev.fit_evidence(kernel_df(spark, [[0.5]]), ["z0"], 0.05, estimator="cube", n_samples=512).integral()
    assert math.isclose(half, full / 2, rel_tol=1e-2)


def test_gain_in_two_dimensions(spark):
    fitted = ev.fit_evidence(kernel_df(spark, [[0.3, 0.3], [0.32, 0.28], [0.28, 0.31]]), ["z0", "z1"], 0.1)
    assert math.isclose(fitted.integral(), 0.18834766, abs_tol=1e-7)
    cands = spark.createDataFrame([(0, 0.3, 0.3), (1, 0.8, 0.8)], "cand_id int, z0 double, z1 double")
    near, far = [r["gain"] for r in ev.with_gain(cands, fitted).orderBy("cand_id").collect()]
    assert math.isclose(near, 0.01977149, abs_tol=1e-7) and math.isclose(far, 0.10907235, abs_tol=1e-7)


def brute_integral(z, w, sigma, alpha):
    d = z.shape[1]
    p, q = ev.axis_probes(sigma)
    total = 0.0
    for k in range(d):
        y = z[:, k][:, None] + p[None]
        rho = (w[None, None] * np.exp(-((y[:, :, None] - z[:, k][None, None]) ** 2) / (2 * sigma**2))).sum(-1)
        total += (w[:, None] * q[None] * ((y >= 0) & (y <= 1)) / (1 + rho)).sum()
    o, ow = ev.shell_probes(d, sigma)
    y = z[:, None] + o[None]
    rho = (w * np.exp(-((y[:, :, None] - z[None, None]) ** 2).sum(-1) / (2 * sigma**2))).sum(-1)
    joint = (w[:, None] * ow[None] * ((y >= 0) & (y <= 1)).all(-1) / (1 + rho)).sum()
    return alpha * total / d + (1 - alpha) * joint


@pytest.mark.parametrize("dim,sigma", [(1, 0.04), (2, 0.07), (3, 0.15)])
def test_against_all_pairs(spark, dim, sigma):
    rng = np.random.default_rng(dim)
    z = np.clip(rng.normal(0.4, 0.2, (30, dim)), 0, 1)
    w = rng.random(30) * 20
    fitted = ev.fit_evidence(kernel_df(spark, z.tolist(), w.tolist()), [f"z{i}" for i in range(dim)], sigma)
    a = dim / (dim + 1)
    assert math.isclose(fitted.integral(), brute_integral(z, w, sigma, a), rel_tol=1e-6)
    new, nw = rng.random((3, dim)), np.full(3, 1 / 3)
    want = brute_integral(np.vstack([z, new]), np.concatenate([w, nw]), sigma, a) - brute_integral(z, w, sigma, a)
    assert math.isclose(fitted.gain(new, nw), want, abs_tol=1e-6)
    assert math.isclose(fitted.with_points(new, nw).integral(), brute_integral(np.vstack([z, new]), np.concatenate([w, nw]), sigma, a), rel_tol=1e-6)


def test_density_of_a_heavy_clump_and_outside_points(spark):
    rng = np.random.default_rng(4)
    z = np.concatenate([np.tile([[0.2, 0.7]], (500, 1)), rng.random((200, 2)) * 1.3 - 0.15])
    w = np.concatenate([np.full(500, 1e6), np.ones(200)])
    fitted = ev.fit_evidence(kernel_df(spark, z.tolist(), w.tolist()), ["z0", "z1"], 0.08, marginal_weight=1.0)
    x = np.concatenate([rng.random((50, 2)), [[1.6, 0.5], [-0.5, -0.4]]])
    want = (w * np.exp(-((x[:, None] - z[None]) ** 2).sum(-1) / (2 * 0.08**2))).sum(1)
    got = fitted.density(x)
    # 1e-10 of the total weight is the floor of what doubles can tell apart here.
    assert np.allclose(got, want, rtol=1e-8, atol=w.sum() * 1e-14)


def test_evidence_saturates(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1e6,)], "d double").select(ev.evidence(F.col("d")).alias("e"))
    got = [r["e"] for r in df.collect()]
    assert got[0] == 0 and got[1] == 0.5 and got[2] > 0.999998


def test_too_many_dimensions_for_the_joint_part(spark):
    df = kernel_df(spark, [[0.1, 0.2, 0.3, 0.4], [0.5, 0.6, 0.7, 0.8]])
    names = [f"z{i}" for i in range(4)]
    with pytest.raises(ValueError):
        ev.fit_evidence(df, names, 0.1)
    assert ev.fit_evidence(df, names, 0.1, marginal_weight=1.0).integral() > 0


def test_kernel_table_of_plain_and_updated_runs(spark):
    exps = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 3)], "exp_code string, p double, n int")
    log = spark.createDataFrame([("b", 0, "i", 1, "p", 5.0), ("b", 1, "i", 2, "p", 6.0)], "exp_code string, seq long, iterator_code string, step_index int, param string, value double")
    got = rows(ev.kernel_table(exps, log, [Axis("n", "i", 4)], ["p"]), "exp_code", "step")
    assert got == [("a", None, 1.0, 1.0), ("b", 1, 0.5, 5.0), ("b", 2, 0.5, 6.0)]


def test_active_dims_and_bounds(spark):
    df = kernel_df(spark, [[0.1, 0.5], [0.2, 0.5]])
    assert ev.active_dims(df, ["z0", "z1"]) == ["z0"]
    assert ev.active_dims(df.limit(1), ["z0", "z1"]) == ["z0", "z1"]
    stats = {"a": prep.Stats("a", "standard", mean=1.0, std=2.0), "b": prep.Stats("b", "standard", mean=0.0, std=1.0)}
    got = ev.latent_bounds(stats, {"a": (5.0, 1.0), "b": None, "c": (1.0, 2.0)})
    assert math.isclose(got["a"][1], 2.0, rel_tol=1e-6) and got["b"] == (-1e6, 1e6) and got["c"] == (0.0, 1.0)


def test_sobol_columns_equal_the_array_version(spark):
    names = [f"u{d}" for d in range(21)]
    got = np.array(rows(design.unit_points(spark.range(64), "id", names, 9).orderBy("id").select(*names)))
    assert np.allclose(got, design.sobol_points(np.arange(64), 21, 9), atol=0)
    # One point in every one of 64 strata per dimension, shifted or not.
    for d in range(21):
        assert sorted(np.floor(got[:, d] * 64).astype(int)) == list(range(64))
    plane = np.floor(got[:, :2] * 8).astype(int)
    assert len({tuple(p) for p in plane}) == 64


def test_strata_share_the_rows(spark):
    cats = [Param("a", "category", vocab=("x", "y")), Param("b", "category", vocab=("p", "q"))]
    out = design.assign_strata(spark.range(10), "id", 10, cats).groupBy("a", "b").count()
    assert rows(out, "a", "b") == [("x", "p", 3), ("x", "q", 3), ("y", "p", 2), ("y", "q", 2)]
    few = design.assign_strata(spark.range(3), "id", 3, cats)
    assert [r["stratum"] for r in few.orderBy("id").collect()] == [0, 1, 2]


def test_design_in_range(spark):
    spec = [Param("speed", "real", 5.0, 205.0), Param("n", "int", 1, 4), Param("c", "category", vocab=("A", "B"))]
    out = design.sobol_design(spark.range(128), "id", spec, 128, fixed={"c": "B"}, derived={"m": F.col("n") * 2})
    low, high, ns = out.agg(F.min("speed"), F.max("speed"), F.count_distinct("n")).first()
    assert low >= 5 and high <= 205 and ns == 4
    assert out.where("c <> 'B' OR m <> 2 * n").isEmpty()
    with pytest.raises(ValueError):
        design.sobol_design(spark.range(3), "id", spec, 3, trajectories=True)


def test_bounds(spark):
    spec = [Param("x", "real", 0, 10), Param("c", "category", vocab=("A", "B", "C"))]
    assert design.global_bounds(spec, {"x": (2, 3)}) == {"x": (2.0, 3.0), "c": (0.0, 2.0)}
    assert design.global_bounds(spec, {"x": (2, 3)}, {"x": 5, "c": "B"}) == {"x": (5.0, 5.0), "c": (1.0, 1.0)}
    with pytest.raises(ValueError):
        design.global_bounds(spec, {"x": (-1, 3)})


def test_acquisition_extremes_and_grid(spark):
    fitted = ev.fit_evidence(kernel_df(spark, [[0.3, 0.3]]), ["z0", "z1"], 0.1)
    pts = design.sweep(spark.range(1), ("z0", 0.0, 1.0, 5), ("z1", 0.0, 1.0, 5))
    perf = (F.col("z0") + F.col("z1")) / 2
    gain = {(r["ix"], r["iy"]): r["gain"] for r in ev.with_gain(pts, fitted).collect()}
    for kappa in (0, 0.25, 0.5, 1):
        out = acquire.acquisition(pts, kappa, perf if kappa < 1 else None, fitted if kappa > 0 else None)
        assert ("gain" in out.columns) == (kappa > 0) and ("perf" in out.columns) == (kappa < 1)
        for r in out.collect():
            want = (1 - kappa) * (r["z0"] + r["z1"]) / 2 + kappa * gain[(r["ix"], r["iy"])]
            assert math.isclose(r["score"], want, abs_tol=1e-9)
    with pytest.raises(ValueError):
        acquire.blend(F.lit(1), F.lit(1), 2)


def test_discovery_spreads_and_counts_pending_points(spark):
    fitted = ev.fit_evidence(kernel_df(spark, [[0.5, 0.5]]), ["z0", "z1"], 0.1)
    pool = design.unit_points(spark.range(64), "id", ["z0", "z1"]).withColumnRenamed("id", "cand_id")
    got = acquire.discover(pool, fitted, 4).collect()
    assert len({r["cand_id"] for r in got}) == 4
    gains = [r["gain"] for r in got]
    assert all(a >= b - 1e-9 for a, b in zip(gains, gains[1:]))
    z = np.array([[r["z0"], r["z1"]] for r in got])
    dist = np.linalg.norm(z[:, None] - z[None], axis=-1)[np.triu_indices(4, 1)]
    assert dist.min() > 0.2


def test_proposal_records_its_source(spark):
    fitted = ev.fit_evidence(kernel_df(spark, [[0.5, 0.5]]), ["z0", "z1"], 0.1)
    pool = design.unit_points(spark.range(32), "id", ["z0", "z1"]).withColumnRenamed("id", "cand_id")
    one = acquire.propose(pool, None, F.col("z0"), fitted).collect()
    assert len(one) == 1 and one[0]["source"] == "exploration_step" and '"kappa":0.5' in one[0]["config_snapshot"]
    assert acquire.propose(pool, 0, F.col("z0")).first()["source"] == "inference_step"


def test_trajectory_layers(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 3), (1, 0.0, 0.5, 1)], "cand_id int, mid double, slope double, l int")
    out = design.trajectory_layers(df, F.col("l"), {"v": (F.col("mid"), F.col("slope"))})
    got = rows(out.select("cand_id", "step", "v", "weight", "is_event"), "cand_id", "step")
    assert got[0] == (0, 0, 0.5, 1 / 3, False) and got[2][4] is True and got[3] == (1, 0, 0.5, 1.0, False)


def test_trajectory_gain_uses_all_points(spark):
    fitted = ev.fit_evidence(kernel_df(spark, [[0.2, 0.2]]), ["z0", "z1"], 0.1)
    df = spark.createDataFrame([(0, [[0.8, 0.8], [0.2, 0.8]])], "cand_id int, pts array<array<double>>")
    got = ev.with_gain(df, fitted, points="pts").first()["gain"]
    assert math.isclose(got, fitted.gain(np.array([[0.8, 0.8], [0.2, 0.8]]), np.array([0.5, 0.5])))


def test_four_dimensions_against_all_pairs(spark):
    from runlattice.operators import evidence_wide as wide

    rng = np.random.default_rng(8)
    z = np.concatenate([np.tile([[0.2, 0.7, 0.4, 0.5]], (20, 1)), rng.random((40, 4))])
    w = rng.random(60) * 5
    names = [f"z{i}" for i in range(4)]
    df = kernel_df(spark, z.tolist(), w.tolist())
    x = rng.random((15, 4))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "cand_id int, " + ", ".join(f"{n} double" for n in names))
    got = [r["density"] for r in wide.density(pts, df, names, 0.1).orderBy("cand_id").collect()]
    want = (w * np.exp(-((x[:, None] - z[None]) ** 2).sum(-1) / (2 * 0.1**2))).sum(1)
    assert np.allclose(got, want, atol=1e-8)
    base = brute_integral(z, w, 0.1, 0.8)
    assert math.isclose(wide.integral(df, names, 0.1).first()["integral"], base, rel_tol=1e-6)
    few = pts.where("cand_id < 4")
    got = [r["gain"] for r in wide.gain(few, df, names, 0.1).orderBy("cand_id").collect()]
    for i, g in enumerate(got):
        more = brute_integral(np.vstack([z, x[i : i + 1]]), np.append(w, 1.0), 0.1, 0.8)
        assert math.isclose(g, more - base, abs_tol=1e-6)


def test_crowded_cells_are_cut_into_blocks(spark):
    from runlattice.functions import blocks

    def count(p, s):
        assert len(p) < 2 * blocks.BLOCK and len(s) < 2 * blocks.BLOCK
        return np.full(len(p), float(len(s)))

    pts = spark.range(1500).select((F.col("id") / 1e6).alias("z0"))
    src = spark.range(2000).select((F.col("id") / 1e6).alias("z0"))
    out = blocks.sums_in_reach(pts, src, ["z0"], [], [], 1.0, count, "n")
    assert out.agg(F.min("n"), F.max("n"), F.count("*")).first() == (2000.0, 2000.0, 1500)


def uniform(spark, n, dims, seed=4):
    z = np.random.default_rng(seed).random((n, dims))
    names = [f"z{i}" for i in range(dims)]
    return z, names, spark.createDataFrame([(*map(float, r), 1.0) for r in z], ", ".join(f"{c} double" for c in names) + ", w double")


@pytest.mark.parametrize("dims, n", [(1, 400), (2, 3000)])
def test_nodes_of_crowded_cells_keep_sums(spark, dims, n):
    """All kernels in a few cells, some far off: nodes take the crowds' place, weights and densities stay."""
    z, names, _ = uniform(spark, n, dims)
    z[:5] += 1e7
    df = spark.createDataFrame([(*map(float, r), 0.5) for r in z], ", ".join(f"{c} double" for c in names) + ", w double")
    few = evidence_wide.thinned(df, names, [], "w", 0.5, 14)
    got = np.array([tuple(r) for r in few.select(*names, "w").collect()])
    assert len(got) <= 2**dims * 14**dims + 5 < n and abs(got[:, -1].sum() - 0.5 * n) < 1e-6
    at = np.random.default_rng(1).random((40, dims))
    direct = 0.5 * np.exp(-((at[:, None] - z[None]) ** 2).sum(2) / (2 * 0.5**2)).sum(1)
    thin = np.exp(-((at[:, None] - got[None, :, :-1]) ** 2).sum(2) / (2 * 0.5**2)) @ got[:, -1]
    assert np.allclose(thin, direct, rtol=1e-8)


def test_boxes_spare_work_in_four_dimensions(spark):
    z, names, df = uniform(spark, 6000, 4)
    z[3000:] += 3.0
    df = spark.createDataFrame([(*map(float, r), 1.0) for r in z], ", ".join(f"{c} double" for c in names) + ", w double")
    compared = blocks.sums_in_reach(df, df, names, [], ["w"], 0.08 * 3, lambda p, s: np.full(len(p), float(len(s))), "n").agg(F.sum("n")).first()[0]
    near = blocks.sums_in_reach(df, df, names, [], ["w"], 0.08 * 3, lambda p, s: (((p[:, None] - s[None, :, :4]) ** 2).sum(2) <= 0.24**2).sum(1).astype(float), "n")
    want = (((z[:2000, None] - z[None]) ** 2).sum(2) <= 0.24**2).sum(1)
    got = {tuple(r[:4]): r["n"] for r in near.collect()}
    assert [got[tuple(r)] for r in z[:2000]] == want.tolist()
    assert compared <= 0.5 * len(z) ** 2  # the two clumps never meet


def test_splits_draw_their_sample_where_the_rows_lie(spark, monkeypatch):
    """No partition sends a sample of its own to the driver, and blocks have their size all the same."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    monkeypatch.setattr(blocks, "SAMPLE", 1000)
    df = spark.range(0, 20000, 1, 40).select((F.col("id") / 20000).alias("z0"), F.rand(3).alias("z1"))
    sizes = [len(r["rows"]) for r in blocks._blocks(df, ["z0", "z1"], ["z0", "z1"], lambda n: blocks.BLOCK).select("rows").collect()]
    assert sum(sizes) == 20000 and len(sizes) >= 64
    assert not any("TakeOrdered" in p for p in plans)


def test_sums_are_spread_over_all_partitions(spark):
    _, names, df = uniform(spark, 3000, 4)
    sums = blocks.sums_in_reach(df, df, names, [], ["w"], 9.0, lambda p, s: np.full(len(p), float(len(s))), "n")
    assert sums.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sums.agg(F.count("*"), F.min("n"), F.max("n")).first() == (3000, 3000.0, 3000.0)


@pytest.mark.parametrize("far", [0.0, 500.0])
def test_probes_of_a_point_by_a_product(far):
    """Densities at probes by factors equal those by distances, also where blocks hold rows too far apart for factors."""
    rng = np.random.default_rng(2)
    points, sources = rng.random((40, 4)), np.column_stack([rng.random((90, 4)), rng.random(90)])
    points[:9] += far
    sources[:20, :4] += far
    offsets, _ = ev.shell_probes(4, 0.08)
    at = points[:, None] + offsets[None]
    want = np.exp(-((at[:, :, None] - sources[None, None, :, :4]) ** 2).sum(-1) / (2 * 0.08**2)) @ sources[:, 4]
    assert np.allclose(evidence_wide._around(points, sources, 4, 0.08, offsets), want, rtol=1e-9, atol=1e-12)


def test_any_bounds_and_no_kernels(spark):
    _, names, df = uniform(spark, 30, 2)
    inside = evidence_wide.integral(df, names, 0.1).first()[0]
    assert abs(inside - ev.fit_evidence(df, names, 0.1).integral()) < 1e-9
    assert evidence_wide.integral(df, names, 0.1, bounds=[(-1e6, 1e6)] * 2).first()[0] > inside
    assert evidence_wide.integral(df, names, 0.1, bounds=[(5.0, 6.0)] * 2).first()[0] == 0.0
    assert evidence_wide.integral(df.limit(0), names, 0.1).first()[0] == 0.0


def test_a_hundred_million_strata_need_no_list(spark):
    cats = [Param(f"c{d}", "category", vocab=tuple(f"{d}{i}" for i in range(10))) for d in range(8)]
    assert design.count_strata(cats) == 10**8
    numbers = [0, 7, 12_345_678, 99_999_999]
    picked = design.strata(spark, cats).where(F.col("stratum").isin(numbers)).orderBy("stratum").collect()
    assert [(r["stratum"], *r[1:]) for r in picked] == [(n, *[f"{d}{c}" for d, c in enumerate(f"{n:08d}")]) for n in numbers]
    out = design.assign_strata(spark.range(12), "id", 12, cats[:2]).orderBy("id").collect()
    assert [(r["c0"], r["c1"]) for r in out] == [(f"0{i // 10}", f"1{i % 10}") for i in range(12)]


def test_probes_of_kernels_taken_by_series(monkeypatch):
    """What probes lose to points, near, far and beyond factors, equals the sum probe by probe; the series and single offsets agree."""
    rng = np.random.default_rng(3)
    points, kernels = np.column_stack([rng.random((50, 4)), 1 + rng.random(50)]), np.column_stack([rng.random((70, 4)), rng.random(70)])
    offsets, weights = ev.shell_probes(4, 0.08)
    for far, dense in ((0.0, 0.0), (0.0, 2e4), (500.0, 0.0), (0.6, 50.0)):
        z, k = points.copy(), kernels.copy()
        z[:, 0] += far
        z[:9], k[:9] = points[:9], kernels[:9]
        k[9:12, :4] = z[9:12, :4]
        rho = dense + 5 * rng.random((len(k), len(offsets)))
        y = k[:, None, :4] + offsets
        v = k[:, 4:5] * weights * ((y >= 0) & (y <= [1e3, 1, 1, 1])).all(axis=2)
        delta = z[:, 4][:, None, None] * np.exp(-((z[:, None, None, :4] - y) ** 2).sum(-1) / (2 * 0.08**2))
        want = (v * delta / ((1 + rho) * (1 + rho + delta))).sum((1, 2))
        bounds = [(0.0, 1e3), *[(0.0, 1.0)] * 3]
        got = evidence_wide._taken(z, np.column_stack([k, rho]), 4, 0.08, offsets, weights, bounds)
        assert np.allclose(got, want, rtol=1e-8, atol=1e-16)
        with monkeypatch.context() as m:
            m.setattr(evidence_wide, "ORDERS", 0)
            assert np.allclose(evidence_wide._taken(z, np.column_stack([k, rho]), 4, 0.08, offsets, weights, bounds), want, rtol=1e-8, atol=1e-16)


def test_gain_sends_kernels_not_their_probes(spark, monkeypatch):
    sent, real = [], evidence_wide.sums_in_reach
    monkeypatch.setattr(evidence_wide, "sums_in_reach", lambda p, s, dims, *a, **k: sent.append((len(dims), s.count())) or real(p, s, dims, *a, **k))
    _, names, df = uniform(spark, 300, 4)
    got = evidence_wide.gain(df.limit(3).withColumn("cand_id", F.monotonically_increasing_id()), df, names, 0.08).collect()
    assert len(got) == 3 and len(sent) == 6 and all(n <= 300 for dims, n in sent if dims == 4)


@pytest.mark.parametrize("points, sources", [(4000, 300), (40, 9000), (3000, 3000)])
def test_sources_go_once_to_each_group_of_points(spark, monkeypatch, points, sources):
    """Few points meet many sources without a copy for each block of points, and sums of several tasks are added up."""
    monkeypatch.setattr(blocks, "BLOCK", 16)
    _, names, df = uniform(spark, sources, 2)
    _, _, pts = uniform(spark, points, 2, 5)
    each = blocks.sums_in_reach(pts, df, names, [], ["w"], 9.0, lambda p, s: np.full(len(p), s[:, 2].sum()), "n")
    assert each.agg(F.count("*"), F.min("n"), F.max("n")).first() == (points, sources, sources)
    two = blocks.sums_in_reach(
        pts, df, names, [], ["w"], 9.0, lambda p, s: np.full((len(p), 2), [1.0, 2.0]) * len(s), "n", lambda p, total: total + p[:, :1], 2
    )
    assert two.agg(F.count("*"), F.max(F.abs(F.get("n", F.lit(0)) - F.col("z0") - sources))).first()[0] == points
    assert two.agg(F.max(F.abs(F.get("n", F.lit(1)) - F.col("z0") - 2 * sources))).first()[0] < 1e-9


@pytest.mark.parametrize("points, sources", [(6e6, 4e5), (4e4, 1e9), (1e8, 1e8), (30, 30)])
def test_copies_grow_with_the_root_of_the_product(points, sources):
    groups, parts = blocks._shares(200, 10**6, 10**6, int(points), int(sources))
    assert groups * blocks.HELD * 2 > points and groups * parts <= 400
    assert groups * sources + parts * points <= 8 * (points + sources + (200 * points * sources) ** 0.5)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_rows_are_never_sent_whole_to_meet_their_crowded_cells(spark, monkeypatch, few):
    """Exploded rows look as small as those before: the cells may be broadcast if few, the rows never."""
    monkeypatch.setattr(evidence_wide, "FEW", few, raising=False)
    _, names, df = uniform(spark, 60, 2)
    many = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(80)))).select(*[(F.col(c) + F.col("_i") * 1e-7).alias(c) for c in names], "w")
    out = evidence_wide.thinned(many, names, [], "w", 0.5, 14)
    plan = plan_of(out)
    assert "BuildLeft" not in plan and plan.count("BroadcastExchange") == (2 if few else 0)
    assert abs(out.agg(F.sum("w")).first()[0] - 4800) < 1e-6 and out.count() < 4800


def test_no_crowd_no_join(spark):
    _, names, df = uniform(spark, 60, 2)
    out = evidence_wide.thinned(df, names, [], "w", 0.5, 14)
    assert "Join" not in plan_of(out) and rows(out, *names) == rows(df, *names)


def test_probes_by_nodes_and_by_products_agree(spark, monkeypatch, dims=2, n=400):
    """A crowd and a few rows apart: integral and gain, with nodes of probes or a product per kernel, at the bounds too."""
    z = np.random.default_rng(6).random((n, dims)) * 0.1
    z[:4] = np.linspace(0.5, 1.0, 4)[:, None]
    names = [f"z{i}" for i in range(dims)]
    df = spark.createDataFrame([(*map(float, r), 0.5) for r in z], ", ".join(f"{c} double" for c in names) + ", w double")
    offsets, weights = ev.shell_probes(dims, 0.1)

    def brute(kernels, w):
        y, v = (kernels[:, None] + offsets).reshape(-1, dims), np.outer(w, weights).ravel()
        rho = np.exp(-((y[:, None] - kernels[None]) ** 2).sum(2) / 0.02) @ w
        return float((v / (1 + rho))[((y >= 0) & (y <= 1)).all(axis=1)].sum())

    spot = spark.createDataFrame([(7, *[0.1] * dims)], "cand_id int, " + ", ".join(f"{c} double" for c in names))
    base = brute(z, np.full(n, 0.5))
    more = brute(np.vstack([z, [[0.1] * dims]]), np.append(np.full(n, 0.5), 1.0))
    for worth in (-(10**9), 10**9):
        monkeypatch.setattr(evidence_wide, "WORTH", worth, raising=False)
        assert math.isclose(evidence_wide.joint_integral(df, names, 0.1).first()[0], base, rel_tol=1e-7)
        got = evidence_wide.gain(spot, df, names, 0.1, estimator="shell")
        axis = evidence_wide._Frame(names, 0.1, None).gain(spot.withColumn("w", F.lit(1.0)), df, "cand_id", "a").first()["a"]
        assert math.isclose((got.first()["gain"] - axis * dims / (dims + 1)) * (dims + 1), more - base, abs_tol=1e-8)
