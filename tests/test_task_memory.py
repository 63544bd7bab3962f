"""Steps whose tasks hold a row per key: dealt over all tasks however well the rows compress, never sent whole to each of them."""

import contextlib
import io

import pytest
from conftest import rows

from runlattice.operators import quality
from runlattice.plans import catalog, modelling
from runlattice.schema import Axis, Feature
from runlattice.sources import tables as tb
from runlattice.sources import tiers

LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Order 1 with a cell measured twice and one without discount, 2 with a gap, 3 not measured, 4 with a line without a number."""
    path = str(tmp_path_factory.mktemp("tables"))
    lines = [(1, 1, 1.0, 10.0, 0.1), (1, 1, 2.0, 5.5, 0.0), (1, 2, 25.0, 7.0, 0.0), (2, 1, 25.0, 1.0, 0.1), (2, 3, 50.0, 2.0, 0.1), (4, None, 1.0, None, 0.1)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    orders = [(k, 1, "F", 1000.0 * k, "1-URGENT") for k in (1, 2, 2, 3, 4)]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{path}/orders.parquet")
    return path


def test_tiers_are_merged_by_key_over_all_tasks(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5, None)], "exp_code long")

    def have(*codes):
        return spark.createDataFrame([(c, f"{c}") for c in codes], "exp_code long, v string")

    found, missing = tiers.tiered_load(keys, {"memory": have(1, 9), "local": have(1, 2, 2, None), "external": have(2, 3, 4)})
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(missing)
    assert found.rdd.getNumPartitions() % tasks(spark) == 0
    want = [(1, "1", "memory"), (2, "2", "local"), (2, "2", "local"), (3, "3", "external"), (4, "4", "external")]
    assert rows(found, "exp_code") == want and rows(missing, "exp_code") == [(None,), (5,)]


def test_cells_are_dealt_before_they_are_merged(spark, folder):
    cells = tb.cells(spark, folder)
    text = plan(cells)
    assert "Aggregate" not in text[text.index("Exchange") :]
    assert cells.rdd.getNumPartitions() == tasks(spark)
    assert rows(cells, "exp_code", "layer") == [(1, 0, 3.0, 15.5, 0.1), (1, 1, 25.0, 7.0, 0.0), (2, 0, 25.0, 1.0, 0.1), (2, 2, 50.0, 2.0, 0.1), (4, None, 1.0, None, 0.1)]


def test_populated_keeps_one_row_an_experiment(spark, folder):
    got = catalog.populated(spark, folder)
    text = plan(got)
    assert "distinct" not in text and "feature#" not in text[text.index("keys=") : text.index("keys=") + 40]
    assert text.count("FileScan") > text.count("l_extendedprice")  # what the answer does not need is not shuffled either
    assert rows(got, "exp_code") == [(1,), (2,), (4,)]
    some = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "x"), (None, "a"), (None, "b")], "exp_code long, feature string")
    assert rows(quality.populated(some, [Feature("a", 1), Feature("b", 1)]), "exp_code") == [(None,), (1,)]


def test_completeness_keeps_one_row_an_experiment_until_the_sizes_are_known(spark, folder):
    got = catalog.report(spark, folder)
    text = plan(got)
    assert "Broadcast" not in text and "feature#" not in text[: text.index("Join")].split("Project")[-1]
    assert got.rdd.getNumPartitions() == tasks(spark)
    two = [(2, "price", 3, 2, 1, False), (2, "quantity", 3, 2, 1, False), (2, "total_price", 1, 1, 0, True)]
    want = [(1, "price", 2, 1, 1, False), (1, "quantity", 2, 2, 0, True), (1, "total_price", 1, 1, 0, True)]
    want += [r for r in two for _ in range(2)]
    want += [(3, "price", 0, 0, 0, True), (3, "quantity", 0, 0, 0, True), (3, "total_price", 1, 0, 0, False)]
    want += [(4, "price", 0, 0, 0, True), (4, "quantity", 0, 1, -1, False), (4, "total_price", 1, 0, 1, False)]
    assert rows(got, "exp_code", "feature") == want
    assert rows(catalog.incomplete(spark, folder), "exp_code", "feature") == [r[:2] for r in want if not r[5]]
    assert rows(catalog.all_complete(spark, folder)) == [(False,)]


def test_completeness_of_features_without_rows_or_sizes(spark):
    exps = spark.createDataFrame([("a", 2), ("b", None), (None, 1)], "exp_code string, n int")
    vals = spark.createDataFrame([("a", "f", float("nan")), ("b", "f", 1.0), (None, "f", 1.0), ("a", "x", 1.0)], "exp_code string, feature string, value double")
    got = quality.completeness(exps, vals, [Feature("f", 1), Feature("g", 1)], [Axis("n", "i", 3)])
    want = [(None, "f", 1, 0, 0, False), (None, "g", 1, 0, 0, False), ("a", "f", 2, 0, 2, False), ("a", "g", 2, 0, 0, False), ("b", "f", None, 1, None, None), ("b", "g", None, 0, 0, None)]
    assert rows(got, "exp_code", "feature") == want


def test_candidates_meet_their_cells_over_all_tasks(spark, folder):
    full = modelling.rows(spark, folder)
    assert "Broadcast" not in plan(full) and full.rdd.getNumPartitions() == tasks(spark)
    # Order 1: (3, 25) against 25; 2 lacks a cell; 3 and 4 have no cells.
    assert rows(modelling.score_candidates(spark, folder), "cand_id") == [(1, 0.56), (2, 0.0)]
