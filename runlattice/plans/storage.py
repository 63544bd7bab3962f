"""Loading, saving, bundles and streaming delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlattice.operators import asof, models, prep
from runlattice.plans.base import query, sql
from runlattice.plans.catalog import MEMBERS, members, snapshots
from runlattice.plans.grids import CONTEXT, DAYS, EVENTS, _asof_sql
from runlattice.plans.learning import LEARN
from runlattice.plans.learning import fitted as fitted_model
from runlattice.plans.learning import measured
from runlattice.plans.modelling import NORMED, VIEWS, fitted, rows
from runlattice.session import shared_folder
from runlattice.sources import layout, tiers
from runlattice.sources import tables as tb
from runlattice.streaming import updates as su


def supplier_runs(spark, folder):
    """Suppliers as a small study kept as one folder per experiment."""
    return tb.table(spark, folder, "supplier").select(
        F.concat(F.lit("run/"), F.col("s_suppkey").cast("string")).alias("exp_code"), F.col("s_acctbal").alias("balance"), "s_nationkey"
    )


@query("a01_list_experiments", "SELECT 'run/' || s_suppkey AS exp_code FROM supplier")
def list_experiments(spark, folder):
    root = shared_folder(spark, "study")
    layout.write_documents(supplier_runs(spark, folder), root, "parameters")
    return layout.list_experiments(spark, f"{root}/parameters")


@query("a02_documents", "SELECT 'run/' || s_suppkey AS exp_code, s_acctbal AS balance, s_nationkey FROM supplier")
def documents(spark, folder):
    root = shared_folder(spark, "study")
    layout.write_documents(supplier_runs(spark, folder), root, "parameters")
    return layout.read_documents(spark, root, "parameters", "balance double, s_nationkey int")


@query(
    "a03_feature_files",
    "SELECT 'run/' || l_suppkey AS exp_code, CAST(l_linenumber - 1 AS INTEGER) AS layer, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
)
def feature_files(spark, folder):
    root = shared_folder(spark, "study")
    cells = (
        tb.table(spark, folder, "lineitem")
        .groupBy(F.concat(F.lit("run/"), F.col("l_suppkey").cast("string")).alias("exp_code"), (F.col("l_linenumber") - 1).alias("layer"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    layout.write_feature_files(cells, root, "quantity", ["layer"])
    return layout.read_feature_files(spark, root, "quantity", ["layer"])


@query(
    "a04_new_rows",
    sql("SELECT exp_code, layer, price FROM cells WHERE exp_code NOT IN (SELECT exp_code FROM experiments WHERE dataset_code = 'F')", "experiments", "cells"),
)
def new_rows(spark, folder):
    """What a second write adds after the cells of one dataset have been stored."""
    path = shared_folder(spark, "cells")
    cells = tb.cells(spark, folder).select("exp_code", "layer", "price")
    first = tb.experiments(spark, folder).where("dataset_code = 'F'").select("exp_code")
    layout.write_table(cells.join(first, "exp_code", "left_semi"), path, ["exp_code", "layer"])
    return layout.new_rows(cells, layout.read_table(spark, path), ["exp_code", "layer"])


def _tiers(spark, folder):
    exps = tb.experiments(spark, folder).select("exp_code", "total")
    return {
        tiers.MEMORY: exps.where("total < 100000"),
        tiers.LOCAL: exps.where("total < 200000"),
        tiers.EXTERNAL: exps.where("total < 400000"),
    }


@query(
    "a05_tiered_load",
    sql("SELECT exp_code, total, CASE WHEN total < 100000 THEN 'memory' WHEN total < 200000 THEN 'local' ELSE 'external' END AS tier FROM experiments WHERE total < 400000", "experiments"),
)
def tiered_load(spark, folder):
    return tiers.tiered_load(tb.experiments(spark, folder), _tiers(spark, folder))[0]


@query("a05_tiered_missing", sql("SELECT exp_code FROM experiments WHERE total >= 100000", "experiments"))
def tiered_missing(spark, folder):
    return tiers.tiered_load(tb.experiments(spark, folder), _tiers(spark, folder), recompute=True, debug=True)[1]


@query(
    "a06_worth_saving",
    sql("SELECT exp_code, layer, CASE WHEN discount > 0.02 THEN price END AS value FROM cells WHERE exp_code IN (SELECT exp_code FROM cells WHERE discount > 0.02)", "cells"),
)
def worth_saving(spark, folder):
    values = tb.cells(spark, folder).select("exp_code", "layer", F.when(F.col("discount") > 0.02, F.col("price")).alias("value"))
    return tiers.worth_saving(values, keys=["exp_code"])


CODES = """SELECT CASE o_orderstatus WHEN 'F' THEN 'study/discovery/' WHEN 'O' THEN 'discovery/' ELSE 'other/' END ||
    CASE WHEN o_totalprice > 450000 THEN 'failed_' ELSE '' END || o_orderkey AS exp_code FROM orders"""


def codes(spark, folder):
    exps = tb.experiments(spark, folder)
    place = F.when(F.col("dataset_code") == "F", "study/discovery/").when(F.col("dataset_code") == "O", "discovery/").otherwise("other/")
    bad = F.when(F.col("total") > 450000, "failed_").otherwise("")
    return exps.select(F.concat(place, bad, F.col("exp_code").cast("string")).alias("exp_code"))


@query(
    "a07_populate",
    f"SELECT exp_code FROM ({CODES}) WHERE (contains(exp_code, '/discovery/') OR starts_with(exp_code, 'discovery/')) AND NOT contains(exp_code, 'failed')",
)
def populate(spark, folder):
    both = codes(spark, folder)
    return tiers.populate(both, both.where("exp_code LIKE 'discovery/%'"), "discovery")


@query(
    "a08_provenance",
    sql(
        "SELECT exp_code, CASE WHEN total < 250000 THEN 'local' ELSE 'external' END AS tier, cust AS seed FROM experiments WHERE total >= 100000",
        "experiments",
    ),
)
def provenance(spark, folder):
    snaps = snapshots(spark, folder)
    local = tb.experiments(spark, folder).where("total < 250000").select("exp_code")
    found, _ = tiers.tiered_load(snaps, {tiers.LOCAL: snaps.join(local, "exp_code", "left_semi"), tiers.EXTERNAL: snaps})
    return found.select("exp_code", "tier", F.get_json_object("config_snapshot", "$.seed").cast("long").alias("seed"))


@query("a09_sets_json", sql("SELECT set_code, ordered, pos, CAST(exp_code AS VARCHAR) AS exp_code FROM members", "experiments", extra=MEMBERS))
def sets_json(spark, folder):
    return layout.sets_from_json(layout.sets_to_json(members(spark, folder)))


@query("a11_pull", sql("SELECT exp_code, layer, quantity FROM cells WHERE exp_code IN (SELECT exp_code FROM experiments WHERE priority = '1-URGENT')", "experiments", "cells"))
def pull(spark, folder):
    keys = tb.experiments(spark, folder).where("priority = '1-URGENT'").select("exp_code")
    return tiers.pull(tb.cells(spark, folder).select("exp_code", "layer", "quantity"), keys)[0]


@query(
    "a12_norm_state",
    sql("SELECT exp_code, cell_idx, round((total - m) / (s + 1e-8), 6) AS total FROM rows, st", *VIEWS, extra=NORMED),
)
def norm_state(spark, folder):
    path = shared_folder(spark, "norm-stats")
    prep.stats_table(spark, fitted(spark, folder, "total", "price")).write.parquet(path)
    again = prep.stats_from_table(spark.read.parquet(path))
    return prep.apply_norm(rows(spark, folder), {"total": again["total"]}).select("exp_code", "cell_idx", F.round("total", 6).alias("total"))


@query("a13_bundle", sql("SELECT exp_code, layer, round(pred_price, 3) AS price FROM prd", "experiments", "cells", extra=LEARN))
def bundle(spark, folder):
    path = shared_folder(spark, "bundle")
    sample = measured(spark, folder)
    models.save_bundle(fitted_model(spark, folder), path, spark, sample)
    out = models.bundle_predict(sample.drop("price"), models.load_bundle(path, spark), ["exp_code", "layer"])
    return out.withColumn("price", F.round("price", 3))


@query(
    "a14_experiment_code",
    "SELECT o_orderkey AS number, 'study_' || CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS exp_code FROM orders",
)
def experiment_code(spark, folder):
    return tb.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("number"), layout.experiment_code("study", F.col("o_orderkey")).alias("exp_code")
    )


@query("s01_streamed_updates", _asof_sql(CONTEXT))
def streamed(spark, folder):
    """Updates delivered as a stream resolve to the same parameters as the whole log at once."""
    schema = tb.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    base = shared_folder(spark, "updates")
    log = su.stream_updates(tb.as_updates(events), f"{base}/log", f"{base}/checkpoint")
    return asof.effective_params(tb.users(spark, folder), log, DAYS, EVENTS).select("exp_code", "cell_idx", *EVENTS)
