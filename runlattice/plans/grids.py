"""Grid, as-of and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlattice.operators import asof, grid
from runlattice.plans.base import query, sql
from runlattice.schema import Feature
from runlattice.sources import tables as tb

LAYERS = [tb.LAYER]
DAYS = [tb.DAY, tb.HOUR]
EVENTS = list(tb.EVENT_TYPES)


@query("c01_expand_domain", sql("SELECT exp_code, day, hour, cell_idx FROM ugrid", "ugrid"))
def expand(spark, folder):
    return grid.expand_domain(tb.users(spark, folder), DAYS).select("exp_code", "day", "hour", "cell_idx")


@query(
    "c01_expand_domain_slice",
    sql("SELECT exp_code, day, cell_idx FROM (SELECT exp_code, day, CAST(day AS BIGINT) AS cell_idx FROM ugrid WHERE hour = 0) WHERE cell_idx >= 3 AND cell_idx < 11", "ugrid"),
)
def expand_slice(spark, folder):
    return grid.expand_domain(tb.users(spark, folder), DAYS, depth=1, start=3, stop=11).select("exp_code", "day", "cell_idx")


@query("c02_strides", sql("SELECT exp_code, CAST(n_hours AS BIGINT) AS day_stride, CAST(1 AS BIGINT) AS hour_stride FROM users", "users"))
def strides(spark, folder):
    return tb.users(spark, folder).select(
        "exp_code", grid.stride(DAYS, "n_days").alias("day_stride"), grid.stride(DAYS, "hour").alias("hour_stride")
    )


@query(
    "c03_step_range",
    sql("SELECT exp_code, cell_idx, hour FROM ugrid WHERE cell_idx >= 2 * n_hours AND cell_idx < 3 * n_hours", "ugrid"),
)
def one_step(spark, folder):
    full = grid.expand_domain(tb.users(spark, folder), DAYS)
    return grid.step_range(full, DAYS, "day", 2).select("exp_code", "cell_idx", "hour")


@query("c04_num_rows", sql("SELECT exp_code, CAST(n_days AS BIGINT) * n_hours AS n_rows FROM users", "users"))
def rows(spark, folder):
    return tb.users(spark, folder).select("exp_code", grid.num_rows(DAYS).alias("n_rows"))


@query(
    "c05_positions",
    sql("SELECT exp_code, layer, round(layer / greatest(n_layers - 1, 1), 9) AS layer_pos FROM grid", "grid"),
)
def positions(spark, folder):
    full = grid.expand_domain(tb.sized_experiments(spark, folder), LAYERS)
    return grid.with_positions(full, LAYERS).select("exp_code", "layer", F.round("layer_pos", 9).alias("layer_pos"))


@query(
    "c06_table_to_grid",
    sql("SELECT exp_code, cell_idx, layer, quantity FROM grid LEFT JOIN cells USING (exp_code, layer)", "grid", "cells"),
)
def filled(spark, folder):
    return grid.fill_grid(tb.cells(spark, folder), tb.sized_experiments(spark, folder), LAYERS, "quantity").select(
        "exp_code", "cell_idx", "layer", "quantity"
    )


@query(
    "c06_dense_chunks",
    sql(
        """SELECT exp_code, CAST(cell_idx // 512 AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS length,
        CAST(sum(coalesce(n, 0) * (cell_idx % 512)) AS DOUBLE) AS weighted
        FROM ugrid LEFT JOIN ucells USING (exp_code, day, hour) GROUP BY 1, 2""",
        "ugrid", "ucells",
    ),
)
def dense(spark, folder):
    full = grid.fill_grid(tb.user_cells(spark, folder), tb.users(spark, folder), DAYS, "n")
    chunks = grid.to_dense(full, DAYS, "n", chunk=512)
    at = F.transform("values", lambda v, i: F.coalesce(v, F.lit(0)) * i)
    return chunks.select(
        "exp_code", "chunk", F.size("values").alias("length"),
        F.aggregate(at, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("double").alias("weighted"),
    )


@query(
    "c06_out_of_bounds",
    sql("SELECT exp_code, day, hour, n FROM ucells WHERE hour >= 20", "ucells"),
)
def outside(spark, folder):
    short = tb.users(spark, folder).withColumn("n_hours", F.lit(20))
    return grid.out_of_bounds(tb.user_cells(spark, folder), short, DAYS).select("exp_code", "day", "hour", "n")


@query(
    "c07_grid_to_table",
    sql("SELECT exp_code, cell_idx, day, hour, value FROM ugrid LEFT JOIN ucells USING (exp_code, day, hour)", "ugrid", "ucells"),
)
def sparse(spark, folder):
    full = grid.fill_grid(tb.user_cells(spark, folder), tb.users(spark, folder), DAYS, "value")
    return grid.to_sparse(grid.to_dense(full, DAYS, "value", chunk=512), DAYS, "value", chunk=512)


DAY_VALUE = {"daily": "SELECT exp_code, day, round(sum(value), 2) AS day_total FROM ucells GROUP BY 1, 2"}


@query(
    "c08_value_at",
    sql(
        """SELECT exp_code, day, hour, value, day_total, CAST(NULL AS DOUBLE) AS deeper
        FROM ugrid LEFT JOIN ucells USING (exp_code, day, hour) LEFT JOIN daily USING (exp_code, day)""",
        "ugrid", "ucells", extra=DAY_VALUE,
    ),
)
def values(spark, folder):
    full = grid.expand_domain(tb.users(spark, folder).select("exp_code", "n_days", "n_hours"), DAYS)
    cells = tb.user_cells(spark, folder)
    daily = cells.groupBy("exp_code", "day").agg(F.round(F.sum("value"), 2).alias("day_total"))
    out = grid.value_at(full, cells, Feature("value", 2), DAYS)
    out = grid.value_at(out, daily, Feature("day_total", 1), DAYS)
    return out.select("exp_code", "day", "hour", "value", "day_total", F.lit(None).cast("double").alias("deeper"))


@query(
    "c08_value_deeper_mean",
    sql(
        """SELECT exp_code, day, round(v, 6) AS value FROM
        (SELECT DISTINCT exp_code, day FROM ugrid) g LEFT JOIN
        (SELECT exp_code, day, avg(value) AS v FROM ucells GROUP BY 1, 2) m USING (exp_code, day)""",
        "ugrid", "ucells",
    ),
)
def deeper_mean(spark, folder):
    days = grid.expand_domain(tb.users(spark, folder), DAYS, depth=1)
    out = grid.value_at(days, tb.user_cells(spark, folder), Feature("value", 2), DAYS, deeper="mean")
    return out.select("exp_code", "day", F.round("value", 6).alias("value"))


@query("c09_slice_at", sql("SELECT exp_code, day, value FROM ucells WHERE hour = 12", "ucells"))
def sliced(spark, folder):
    return grid.slice_at(tb.user_cells(spark, folder), "hour", 12).select("exp_code", "day", "value")


@query(
    "c10_init_arrays",
    sql("SELECT exp_code, cell_idx, price, CAST(NULL AS DOUBLE) AS fresh FROM grid LEFT JOIN cells USING (exp_code, layer)", "grid", "cells"),
)
def init(spark, folder):
    sized = tb.sized_experiments(spark, folder)
    kept = grid.init_grid(sized, LAYERS, "price", tb.cells(spark, folder)).select("exp_code", "cell_idx", "price")
    return kept.withColumn("fresh", F.lit(None).cast("double"))


def _asof_sql(test: str) -> str:
    best = ", ".join(f"arg_max(value, seq) FILTER (param = '{e}') AS {e}" for e in EVENTS)
    return sql(
        f"""SELECT g.exp_code, g.cell_idx, {', '.join(f'coalesce(b.{e}, 0.0) AS {e}' for e in EVENTS)} FROM ugrid g
        LEFT JOIN (SELECT g.exp_code, g.cell_idx, {best} FROM ugrid g JOIN ups u ON u.exp_code = g.exp_code
        AND (u.iterator_code IS NULL OR {test}) GROUP BY 1, 2) b
        ON b.exp_code = g.exp_code AND b.cell_idx = g.cell_idx""",
        "ugrid", "ups",
    )


CONTEXT = "CASE u.iterator_code WHEN 'n_days' THEN g.day ELSE g.hour END >= u.step_index"
ROW = "g.cell_idx >= u.step_index * CASE u.iterator_code WHEN 'n_days' THEN g.n_hours ELSE 1 END"


@query("c11_effective_context", _asof_sql(CONTEXT))
def asof_context(spark, folder):
    return asof.effective_params(tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS).select(
        "exp_code", "cell_idx", *EVENTS
    )


@query("c12_effective_row", _asof_sql(ROW))
def asof_row(spark, folder):
    return asof.effective_params(tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS, mode="row").select(
        "exp_code", "cell_idx", *EVENTS
    )


def _at_sql(cell: str) -> str:
    best = ", ".join(f"coalesce(arg_max(value, seq) FILTER (param = '{e}'), 0.0) AS {e}" for e in EVENTS)
    return sql(
        f"""SELECT g.exp_code, {best} FROM ugrid g LEFT JOIN ups u ON u.exp_code = g.exp_code
        AND (u.iterator_code IS NULL OR {ROW}) WHERE g.cell_idx = {cell} GROUP BY 1""",
        "ugrid", "ups",
    )


@query("c13_params_at_step", _at_sql("5 * g.n_hours"))
def at_step(spark, folder):
    return asof.params_at_step(tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS, "day", 5).select(
        "exp_code", *EVENTS
    )


@query("c13_params_at_last_row", _at_sql("g.n_days * g.n_hours - 1"))
def at_last(spark, folder):
    return asof.params_at_last_row(tb.users(spark, folder), tb.updates(spark, folder), DAYS, EVENTS).select(
        "exp_code", *EVENTS
    )


def coarse(value):
    return (F.floor(value / 50) * 50.0).alias("value")


def proposals(spark, folder):
    """Every event proposes a coarse value for its type on its day, in the order of the days, after all of the log."""
    step = F.dayofmonth("ts") - 1
    return tb.table(spark, folder, "events").select(
        F.col("user_id").alias("exp_code"), ((step + 1) * F.lit(10**12) + F.col("event_id")).alias("seq"),
        F.lit("day").alias("iterator_code"), step.alias("step_index"), F.col("event_type").alias("param"), coarse(F.col("value")),
    )


@query(
    "c14_record_updates",
    sql(
        f"""SELECT exp_code, seq, step_index, param, value FROM (
        SELECT *, min(CASE WHEN value <> in_log THEN seq END) OVER (PARTITION BY exp_code, param) AS first,
        lag(value) OVER (PARTITION BY exp_code, param ORDER BY seq) AS prior FROM held)
        WHERE seq = first OR (seq > first AND value <> prior)""",
        "ugrid", "ups",
        extra={
            "sizes": "SELECT DISTINCT exp_code, n_hours FROM ugrid",
            "proposed": """SELECT user_id AS exp_code, day(ts) * 1000000000000 + event_id AS seq, CAST(day(ts) - 1 AS INTEGER) AS step_index,
                event_type AS param, floor(value / 50) * 50.0 AS value FROM events""",
            "held": """SELECT p.exp_code, p.seq, p.step_index, p.param, any_value(p.value) AS value,
                coalesce(arg_max(floor(u.value / 50) * 50.0, u.seq), 0.0) AS in_log
                FROM proposed p JOIN sizes s ON s.exp_code = p.exp_code LEFT JOIN ups u ON u.exp_code = p.exp_code AND u.param = p.param
                AND (u.iterator_code IS NULL OR u.step_index * CASE u.iterator_code WHEN 'n_days' THEN s.n_hours ELSE 1 END
                <= p.step_index * s.n_hours) GROUP BY 1, 2, 3, 4""",
        },
    ),
)
def recorded(spark, folder):
    ups = tb.updates(spark, folder)
    log = ups.select(*[c for c in ups.columns if c != "value"], coarse(F.col("value")))
    out = asof.record_updates(tb.users(spark, folder), log, proposals(spark, folder), DAYS, EVENTS)
    return out.select("exp_code", "seq", "step_index", "param", "value")


@query(
    "c15_events_to_trajectory",
    sql(
        """SELECT exp_code, row_number() OVER (PARTITION BY exp_code ORDER BY step_index, seq) - 1 AS pos,
        step_index AS step, param, value FROM ups WHERE iterator_code = 'n_days'""",
        "ups",
    ),
)
def trajectory(spark, folder):
    return asof.events_to_trajectory(tb.updates(spark, folder), DAYS, "day").drop("seq")


@query(
    "c15_trajectory_to_events",
    sql(
        """SELECT exp_code, 'day' AS iterator_code, step_index, param, arg_max(value, seq) AS value
        FROM ups WHERE iterator_code = 'n_days' GROUP BY 1, 3, 4""",
        "ups",
    ),
)
def flat_events(spark, folder):
    ups = tb.updates(spark, folder).where("iterator_code = 'n_days'")
    last = ups.groupBy("exp_code", "step_index", "param").agg(F.max_by("value", "seq").alias("value"))
    per_step = last.groupBy("exp_code", "step_index").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("updates")
    )
    paths = per_step.groupBy("exp_code").agg(
        F.lit("day").alias("dimension"),
        F.collect_list(F.struct(F.col("step_index").alias("step"), F.col("updates"))).alias("steps"),
    )
    flat = asof.trajectory_to_events(paths, DAYS)
    return flat.select("exp_code", "iterator_code", "step_index", F.explode("updates").alias("param", "value"))


@query(
    "c17_expand_experiments",
    sql("SELECT exp_code, layer, round(1.0 / n_layers, 9) AS weight FROM grid", "grid"),
)
def weighted(spark, folder):
    points = grid.expand_domain(tb.sized_experiments(spark, folder), LAYERS)
    return grid.layer_points(points).select("exp_code", "layer", F.round("weight", 9).alias("weight"))


@query(
    "c18_layer_progress",
    sql("SELECT exp_code, layer, round(layer / greatest(n_layers - 1, 1), 9) AS progress FROM grid", "grid"),
)
def progress(spark, folder):
    points = grid.expand_domain(tb.sized_experiments(spark, folder), LAYERS)
    return grid.layer_progress(points, "layer").select("exp_code", "layer", F.round("progress", 9).alias("progress"))
