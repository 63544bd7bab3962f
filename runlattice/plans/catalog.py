"""Validation, completeness, set, split and provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlattice.operators import quality, sets
from runlattice.plans.base import query, sql
from runlattice.schema import Feature, Param
from runlattice.sources import tables as tb

LAYERS = [tb.LAYER]
FEATURES = [Feature("quantity", 1), Feature("price", 1), Feature("total_price", 0)]


def long_values(spark, folder):
    """Long feature table; zero discount cells of the price feature count as not measured."""
    cells = tb.cells(spark, folder)
    measured = cells.select("exp_code", "quantity", F.when(F.col("discount") > 0, F.col("price")).alias("price"))
    deep = measured.unpivot("exp_code", ["quantity", "price"], "feature", "value")
    scalar = cells.groupBy("exp_code").agg(F.round(F.sum("price"), 2).alias("value"))
    return deep.unionByName(scalar.select("exp_code", F.lit("total_price").alias("feature"), "value"))


LONG = {
    "vals": """SELECT exp_code, 'quantity' AS feature, quantity AS value FROM cells
        UNION ALL SELECT exp_code, 'price', CASE WHEN discount > 0 THEN price END FROM cells
        UNION ALL SELECT exp_code, 'total_price', round(sum(price), 2) FROM cells GROUP BY 1""",
    "report": """SELECT s.exp_code, f.feature, CASE WHEN f.feature = 'total_price' THEN CAST(1 AS BIGINT) ELSE CAST(s.n_layers AS BIGINT) END AS expected,
        coalesce(v.actual, 0) AS actual,
        CASE WHEN v.actual IS NULL THEN 0 ELSE CASE WHEN f.feature = 'total_price' THEN 1 ELSE s.n_layers END - v.actual END AS nan
        FROM sized s, (VALUES ('quantity'), ('price'), ('total_price')) f(feature)
        LEFT JOIN (SELECT exp_code, feature, count(value) AS actual FROM vals GROUP BY 1, 2) v
        ON v.exp_code = s.exp_code AND v.feature = f.feature""",
}


def report(spark, folder):
    return quality.completeness(tb.sized_experiments(spark, folder), long_values(spark, folder), FEATURES, LAYERS)


@query(
    "b01_validate",
    sql(
        """SELECT exp_code, 'total' AS param, 'below_min' AS rule FROM experiments WHERE total < 1000
        UNION ALL SELECT exp_code, 'total', 'above_max' FROM experiments WHERE total > 400000
        UNION ALL SELECT exp_code, 'cust', 'below_min' FROM experiments WHERE cust < 10
        UNION ALL SELECT exp_code, 'priority', 'not_in_vocabulary' FROM experiments
        WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')""",
        "experiments",
    ),
)
def validate(spark, folder):
    return quality.violations(tb.experiments(spark, folder), tb.EXPERIMENT_PARAMS).drop("found")


@query(
    "b02_sanitize",
    """SELECT o_orderkey AS exp_code, CAST(round_even(o_totalprice, 0) AS DOUBLE) AS total,
       CAST(round_even(o_totalprice / 1000.0, 0) AS BIGINT) AS cust, (o_totalprice / 500000.0 >= 0.5) AS large,
       o_orderpriority AS priority FROM orders""",
)
def sanitize(spark, folder):
    raw = tb.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("exp_code"), F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") / 1000.0).alias("cust"), (F.col("o_totalprice") / 500000.0).alias("large"),
        F.col("o_orderpriority").alias("priority"),
    )
    spec = [Param("total", digits=0), Param("cust", "int"), Param("large", "bool"), Param("priority", "category", vocab=tb.PRIORITIES)]
    return quality.sanitize(raw, spec)


@query(
    "b06_completeness",
    sql("SELECT exp_code, feature, expected, actual, CAST(nan AS BIGINT) AS nan, actual = expected AS ok FROM report", "sized", "cells", extra=LONG),
)
def completeness(spark, folder):
    return report(spark, folder)


@query(
    "b07_incomplete",
    sql("SELECT exp_code, feature FROM report WHERE actual <> expected", "sized", "cells", extra=LONG),
)
def incomplete(spark, folder):
    return quality.incomplete(report(spark, folder))


@query("b07_all_complete", sql("SELECT bool_and(actual = expected) AS complete FROM report", "sized", "cells", extra=LONG))
def all_complete(spark, folder):
    return quality.is_all_complete(report(spark, folder))


@query(
    "b08_complete_range",
    sql(
        """SELECT s.exp_code, count(c.price) FILTER (c.layer >= 1 AND c.layer < least(s.n_layers, 3))
        >= greatest(least(s.n_layers, 3) - 1, 0) AS complete
        FROM sized s LEFT JOIN cells c USING (exp_code) GROUP BY s.exp_code, s.n_layers""",
        "sized", "cells",
    ),
)
def complete_range(spark, folder):
    return quality.complete_in_range(tb.sized_experiments(spark, folder), tb.cells(spark, folder), LAYERS, "price", 1, 3)


@query("b09_populated", sql("SELECT exp_code FROM vals GROUP BY 1 HAVING count(DISTINCT feature) = 3", "cells", extra={"vals": LONG["vals"]}))
def populated(spark, folder):
    return quality.populated(long_values(spark, folder), FEATURES)


@query(
    "b10_state_report",
    sql(
        """SELECT count(*) AS total, count(total) AS parameters,
        count(*) FILTER (exp_code IN (SELECT exp_code FROM cells)) AS features,
        count(*) FILTER (exp_code IN (SELECT exp_code FROM cells WHERE discount > 0.05)) AS performance FROM experiments""",
        "experiments", "cells",
    ),
)
def state(spark, folder):
    scored = tb.cells(spark, folder).where("discount > 0.05").select("exp_code")
    full = quality.populated(long_values(spark, folder), FEATURES)
    return quality.state_report(tb.experiments(spark, folder), scored, full, ["total"])


@query("d01_select", sql("SELECT exp_code, exp_seq FROM experiments WHERE total >= 250000 AND dataset_code = 'F'", "experiments"))
def select(spark, folder):
    return sets.select(tb.experiments(spark, folder), (F.col("total") >= 250000) & (F.col("dataset_code") == "F"))


MEMBERS = {
    "members": """SELECT priority AS set_code, true AS ordered, exp_code,
        row_number() OVER (PARTITION BY priority ORDER BY exp_seq) - 1 AS pos FROM experiments WHERE total >= 100000""",
}


def members(spark, folder):
    return sets.select_set(tb.experiments(spark, folder), F.col("priority"), F.col("total") >= 100000, ordered=True)


@query("d02_select_set", sql("SELECT set_code, ordered, pos, exp_code FROM members", "experiments", extra=MEMBERS))
def select_set(spark, folder):
    return members(spark, folder)


@query(
    "d03_append",
    sql(
        """SELECT * FROM members UNION ALL
        SELECT priority, true, exp_code, (SELECT max(pos) FROM members m WHERE m.set_code = priority) + row_number() OVER (PARTITION BY priority ORDER BY exp_seq)
        FROM experiments e WHERE total >= 50000 AND total < 100000""",
        "experiments", extra=MEMBERS,
    ),
)
def append(spark, folder):
    more = tb.experiments(spark, folder).where("total >= 50000").select(F.col("priority").alias("set_code"), "exp_code", "exp_seq")
    return sets.append_to_sets(members(spark, folder), more)


@query("d04_window", sql("SELECT set_code, pos, exp_code FROM members WHERE pos < 25", "experiments", extra=MEMBERS))
def window(spark, folder):
    return sets.window(members(spark, folder), 25).select("set_code", "pos", "exp_code")


@query(
    "d05_fit_codes",
    sql(
        """SELECT exp_code, row_number() OVER (ORDER BY part, p) - 1 AS pos FROM (
        SELECT exp_code, min(part) AS part, arg_min(p, part) AS p FROM (
        SELECT exp_code, 0 AS part, row_number() OVER (ORDER BY exp_seq) - 1 AS p FROM experiments WHERE total >= 450000
        UNION ALL SELECT exp_code, 1, pos FROM members WHERE set_code = '2-HIGH' AND pos < 400) GROUP BY 1)""",
        "experiments", extra=MEMBERS,
    ),
)
def fit_codes(spark, folder):
    big = sets.select_set(tb.experiments(spark, folder), F.lit("big"), F.col("total") >= 450000)
    high = sets.window(members(spark, folder).where("set_code = '2-HIGH'"), 400)
    return sets.fit_codes([big, high])


@query("d06_dataset_codes", sql("SELECT dataset_code, min(exp_seq) AS first_seen FROM experiments GROUP BY 1", "experiments"))
def dataset_codes(spark, folder):
    return sets.dataset_codes(tb.experiments(spark, folder))


SPLIT = {
    "free": "SELECT exp_code, row_number() OVER (ORDER BY md5('7:' || exp_code)) - 1 AS pos, count(*) OVER () AS n FROM experiments WHERE dataset_code <> 'P'",
    "cuts": "SELECT *, CAST(round_even(n * 0.2, 0) AS BIGINT) AS nt FROM free",
    "split": """SELECT exp_code, CASE WHEN pos < nt THEN 'test' WHEN pos < nt + CAST(round_even((n - nt) * (0.1::DOUBLE / (1.0 - 0.2)), 0) AS BIGINT)
        THEN 'validation' ELSE 'train' END AS split FROM cuts
        UNION ALL SELECT exp_code, 'test' FROM experiments WHERE dataset_code = 'P'""",
}


def splits(spark, folder):
    exps = tb.experiments(spark, folder)
    preset = exps.where("dataset_code = 'P'").select("exp_code", F.lit("test").alias("split"))
    return sets.split(exps, val=0.1, test=0.2, seed=7, preset=preset)


@query("d07_split", sql("SELECT exp_code, split FROM split", "experiments", extra=SPLIT))
def split(spark, folder):
    return splits(spark, folder)


@query(
    "d08_update",
    sql("SELECT exp_code, CASE WHEN total < 60000 THEN 'test' ELSE 'train' END AS split FROM experiments WHERE total < 60000 OR exp_code IN (SELECT exp_code FROM cells)", "experiments", "cells"),
)
def update(spark, folder):
    old = tb.experiments(spark, folder).where("total < 60000").select("exp_code", F.lit("test").alias("split"))
    return sets.add_new_to_train(old, tb.cells(spark, folder).select("exp_code").distinct())


@query(
    "d09_split_by_tag",
    sql("SELECT exp_code, CASE dataset_code WHEN 'P' THEN 'test' ELSE 'train' END AS split FROM experiments", "experiments"),
)
def split_by_tag(spark, folder):
    return sets.split_by_tag(tb.experiments(spark, folder), {"train": ["F", "O"], "test": ["P"]})


@query(
    "d10_split_sizes",
    sql("SELECT s.split, count(x.exp_code) AS n FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN split x USING (split) GROUP BY 1", "experiments", extra=SPLIT),
)
def split_sizes(spark, folder):
    return sets.split_sizes(splits(spark, folder))


@query(
    "d11_folds",
    sql("SELECT exp_code, (row_number() OVER (ORDER BY md5('3:' || exp_code)) - 1) % 5 AS fold FROM experiments", "experiments"),
)
def folds(spark, folder):
    return sets.folds(tb.experiments(spark, folder), 5, seed=3)


def snapshots(spark, folder):
    """Snapshots as they are stored: known and unknown sources, pairs and broken origins."""
    exps = positioned(spark, folder)
    source = F.when(F.col("dataset_code") == "F", "exploration_step").when(F.col("dataset_code") == "O", "sobol_step").otherwise("manual")
    origin = F.when(F.col("total") < 450000, F.to_json(F.array("priority", F.col("pos").cast("string")))).otherwise(F.lit('["lost"]'))
    text = F.concat(
        F.lit('{"source":"'), source, F.lit('","seed":'), F.col("cust").cast("string"), F.lit(',"kappa":0.5,"origin":'), origin, F.lit("}")
    )
    return exps.select("exp_code", text.alias("config_snapshot"))


def positioned(spark, folder):
    """Experiments of the ordered sets with their place in them."""
    own = members(spark, folder).select("exp_code", "pos")
    return tb.experiments(spark, folder).join(own, "exp_code")


@query(
    "d12_provenance",
    sql(
        """SELECT exp_code, CASE dataset_code WHEN 'F' THEN 'exploration_step' WHEN 'O' THEN 'sobol_step' END AS source, cust AS seed,
        CASE WHEN total < 450000 THEN priority END AS origin_set, CASE WHEN total < 450000 THEN pos END AS origin_pos,
        '0.5' AS kappa, CASE WHEN dataset_code = 'P' THEN 'manual' END AS kept_source,
        CASE WHEN total < 450000 THEN NULL ELSE '["lost"]' END AS kept_origin
        FROM experiments JOIN (SELECT exp_code, pos FROM members) USING (exp_code)""",
        "experiments", extra=MEMBERS,
    ),
)
def provenance(spark, folder):
    parsed = sets.parse_provenance(snapshots(spark, folder))
    keep = {"kappa": "kappa", "kept_source": "source", "kept_origin": "origin"}
    return parsed.select(
        "exp_code", "source", "seed", "origin_set", "origin_pos",
        *[F.try_element_at("settings", F.lit(k)).alias(out) for out, k in keep.items()],
    )


@query(
    "d13_fit_from_provenance",
    sql(
        "SELECT exp_code, priority AS origin_set, pos AS n_members FROM experiments JOIN (SELECT exp_code, pos FROM members) USING (exp_code) WHERE total < 450000",
        "experiments", extra=MEMBERS,
    ),
)
def fit_from_provenance(spark, folder):
    return sets.fit_from_provenance(sets.parse_provenance(snapshots(spark, folder)), members(spark, folder))


