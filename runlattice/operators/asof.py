"""Which parameter values were in force at a cell, given a log of mid-run updates.

The log has columns (exp_code, seq, iterator_code, step_index, param, value); ``seq`` is the
order of entry. An update without iterator or step always applies. Among the updates that
apply to a cell the one entered last wins, separately for each parameter.

Two rules decide what applies:
``context``  the cell's own index on the update's axis has reached the step;
``row``      the flat cell index has reached step × stride, and it stays so for later rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.functions.blocked import BLOCK, best_so_far, chain, positions
from runlattice.operators.grid import KEY, num_rows, stride
from runlattice.operators.quality import coerced, rules
from runlattice.schema import Axis, Param, find_axis

ALWAYS = -1
# Cells that one task expands together: axes are cut into parts that span no more, unless a single index value does.
PART = 4 * BLOCK

def with_axis_position(updates: DataFrame, axes: list[Axis]) -> DataFrame:
    """Accept either spelling of an axis; -1 marks updates that always apply."""
    place = F.when(F.col("iterator_code").isNull() | F.col("step_index").isNull(), ALWAYS)
    for pos, axis in enumerate(axes):
        place = place.when(F.col("iterator_code").isin(axis.size, axis.index), pos)
    return updates.withColumn("axis_pos", place).where("axis_pos IS NOT NULL")


def last_entries(updates: DataFrame, axes: list[Axis], params: list[str]) -> DataFrame:
    """The log reduced to what can win: the last entry per (parameter, axis, step).

    A map-side aggregate, however many entries one experiment has.
    """
    log = with_axis_position(updates, axes).where(F.col("param").isin(*params))
    step = F.when(F.col("axis_pos") == ALWAYS, 0).otherwise(F.greatest(F.col("step_index"), F.lit(0)))
    return (
        log.withColumn("step", step)
        .groupBy(KEY, "param", "axis_pos", "step")
        .agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
        .withColumn("win", F.struct("seq", "value"))
    )


def _wins(params: list[str]) -> list[str]:
    return [f"_w_{p}" for p in params]


def _merged(log: DataFrame, places: DataFrame, by: list[str], params: list[str]) -> DataFrame:
    """Steps of the log and of ``places`` (by, step, and columns of their own), a row each: the winner among the entries of the step,
    a struct (seq, value) per parameter, and the places' columns. Combined before the shuffle."""
    own = [c for c in places.columns if c not in (*by, "step")]
    last = log.groupBy(*by, "step", "param").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    mine = {p: F.col("param") == p for p in params}
    one = places.unionByName(last, allowMissingColumns=True).groupBy(*by, "step").agg(
        *[F.max(c).alias(c) for c in own],
        # One entry a parameter is left.
        *[F.max(F.when(on, F.col(c))).alias(f"_{c}_{p}") for p, on in mine.items() for c in ("seq", "value")],
    )
    wins = [F.struct(F.col(f"_seq_{p}").alias("seq"), F.col(f"_value_{p}").alias("value")).alias(f"_w_{p}") for p in params]
    return one.select(*by, "step", *own, *wins)


def _along_axes(updates: DataFrame, axes: list[Axis], params: list[str]) -> DataFrame:
    """The log by axis (``line``) and step; what always applies stands before the first step of every axis."""
    log = with_axis_position(updates, axes).where(F.col("param").isin(*params))
    every = F.array(*[F.lit(k) for k in range(len(axes))]) if axes else F.array(F.lit(0))
    line = F.explode(F.when(F.col("axis_pos") == ALWAYS, every).otherwise(F.array("axis_pos")))
    step = F.when(F.col("axis_pos") == ALWAYS, F.lit(-1)).otherwise(F.greatest(F.col("step_index"), F.lit(0)))
    return log.select(KEY, line.alias("line"), step.cast("long").alias("step"), "param", "seq", "value")


def _along_cells(updates: DataFrame, experiments: DataFrame, axes: list[Axis], params: list[str]) -> DataFrame:
    """The log by the flat cell that each entry applies from."""
    log = with_axis_position(updates, axes).where(F.col("param").isin(*params)).withColumn("step", F.greatest(F.col("step_index"), F.lit(0)))
    placed = log.join(experiments.select(KEY, *[a.size for a in axes]), KEY)
    return placed.select(KEY, F.lit(0).alias("line"), _event_start(axes).alias("step"), "param", "seq", "value")


def _widths(sizes: list[Column]) -> list[Column]:
    """Index values per part on each line, powers of two: inner lines first, until PART cells are reached."""
    out, left = [], F.lit(PART).cast("long")
    for size in reversed(sizes):
        width = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(left))))).cast("long")
        left = F.greatest(F.lit(1), F.floor(left / F.least(width, F.greatest(size, F.lit(1))))).cast("long")
        out.append(width)
    return out[::-1]


def _parts(df: DataFrame, sizes: list[Column], lines: list[int]) -> DataFrame:
    """A row per part (``_p<k>``) of these lines."""
    widths = _widths(sizes)
    for k in lines:
        last = F.ceil(sizes[k] / widths[k]) - 1
        df = df.where(sizes[k] > 0).withColumn(f"_p{k}", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return df


def _ranges(log: DataFrame, sized: DataFrame, n: int, params: list[str]) -> DataFrame:
    """Ranges [lo, hi) of each line in which no parameter changes, with the winners there, a row per range and part.

    ``sized`` has each experiment's line sizes. Of the log only entries that win somewhere begin a range: what an earlier step
    entered later dominates is gone. Each part begins one too, so none reaches over a part's end. Steps past an experiment's
    own size lie in no part.
    """
    names = [f"_size{k}" for k in range(n)]
    sizes = [F.col(c) for c in names]
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("line"), s.alias("size"), w.alias("width")) for k, (s, w) in enumerate(zip(sizes, _widths(sizes)))]))
    lines = sized.select(KEY, *names, which.alias("_x")).where(F.col("_x.size") > 0)
    starts = lines.select(KEY, F.col("_x.line").alias("line"), *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_x.size") - 1, F.col("_x.width"))).alias("step"))
    merged = _merged(log, starts, [KEY, "line"], params)
    best = best_so_far(merged, [KEY, "line"], "step", _wins(params), {f"_all{c}": c for c in names}, BLOCK)
    inside = Window.partitionBy(KEY, "line", "_blk").orderBy("step")
    told = best.withColumn("_now", F.struct(*[F.col(w)["seq"] for w in _wins(params)])).withColumn("_was", F.lag("_now").over(inside))
    kept = told.where(F.coalesce(*sizes).isNotNull() | ~F.col("_was").eqNullSafe(F.col("_now")))
    ended = kept.withColumn("_next", F.coalesce(F.when(F.col("step") < F.col("_last"), F.lead("step").over(inside)), (F.col("_blk") + 1) * BLOCK))
    all_sizes = [F.col(f"_all{c}") for c in names]
    widths = _widths(all_sizes)
    size, width = (F.element_at(F.array(*x), F.col("line") + 1) for x in (all_sizes, widths))
    inner = ended.where((F.col("step") >= 0) & (F.col("step") < size)).withColumns({"_p": F.floor(F.col("step") / width), "_hi": F.least("_next", size)})
    for k in range(n):
        others = F.sequence(F.lit(0).cast("long"), F.ceil(all_sizes[k] / widths[k]) - 1)
        own = F.array(F.col("_p"))
        inner = inner.where(all_sizes[k] > 0).withColumn(f"_p{k}", F.explode(F.when(F.col("line") == k, own).otherwise(others)) if n > 1 else F.col("_p"))
    return inner.select(KEY, "line", *[f"_p{k}" for k in range(n)], F.col("step").alias("lo"), F.col("_hi").alias("hi"), F.struct(*_wins(params)).alias("won"))


def effective_params(experiments: DataFrame, updates: DataFrame, axes: list[Axis], params: list[str], mode: str = "context") -> DataFrame:
    """The full grid with the parameters in force at each cell.

    The log is reduced to ranges of constant winners, on each axis (context) or along the flat cells (row). Ranges of one part
    of an experiment meet, no more than it has index values, and expand to cells where they are: cells are never
    shuffled, and parts are of bounded size, however long an axis or large an experiment.
    """
    if mode not in ("context", "row"):
        raise ValueError(f"unknown as-of rule {mode!r}")
    flat = mode == "row" or not axes
    sizes = [num_rows(axes)] if flat else [F.col(a.size).cast("long") for a in axes]
    log = _along_cells(updates, experiments, axes, params) if flat else _along_axes(updates, axes, params)
    n = len(sizes)
    parts = [f"_p{k}" for k in range(n)]
    ranges = _ranges(log, experiments.select(KEY, *[s.alias(f"_size{k}") for k, s in enumerate(sizes)]), n, params)
    met = ranges.groupBy(KEY, *parts).agg(*[F.collect_list(F.when(F.col("line") == k, F.struct("lo", "hi", "won"))).alias(f"_r{k}") for k in range(n)])
    df = _parts(experiments, sizes, list(range(n))).join(met, [KEY, *parts])
    for k in range(n):
        df = df.withColumn(f"_r{k}", F.explode(f"_r{k}"))
    for k in range(n):
        df = df.withColumn(f"_i{k}", F.explode(F.sequence(F.col(f"_r{k}.lo"), F.col(f"_r{k}.hi") - 1)))
    if flat:
        at, index = F.col("_i0"), {a.index: F.floor(F.col("_i0") / stride(axes, a.index)) % F.col(a.size) for a in axes}
    else:
        at = reduce(lambda x, y: x + y, [F.col(f"_i{k}") * stride(axes, a.index) for k, a in enumerate(axes)])
        index = {a.index: F.col(f"_i{k}") for k, a in enumerate(axes)}
    won = [F.col(f"_r{k}")["won"] for k in range(n)]
    return df.select(*_in_force(df, experiments.columns, params, won), at.alias("cell_idx"), *[i.cast("int").alias(name) for name, i in index.items()])


def _in_force(df: DataFrame, columns: list[str], params: list[str], won: list[Column]) -> list[Column]:
    """The columns, parameters replaced by the value of the last of the winners."""
    types = df.schema

    def value(p: str) -> Column:
        wins = [w[f"_w_{p}"] for w in won]
        best = F.greatest(*wins) if len(wins) > 1 else wins[0]
        return F.coalesce(best["value"].cast(types[p].dataType), F.col(p)).alias(p)

    return [value(c) if c in params else F.col(c) for c in columns]


def params_at_points(points: DataFrame, experiments: DataFrame, updates: DataFrame, axes: list[Axis], params: list[str]) -> DataFrame:
    """Points (exp_code, line, step: a place on one axis, the others unset; step -1 for no place) with the parameters in force there.

    Points and log merge in the order of steps; the points of one step resolve once.
    """
    wins = _wins(params)
    log = _along_axes(updates, axes, params)
    reach = experiments.select(KEY, F.array(*[F.col(a.size).cast("long") for a in axes], F.lit(1).cast("long")).alias("_size"))
    near = log.join(reach, KEY).where(F.col("step") < F.get("_size", F.col("line"))).drop("_size")
    asked = points.select(KEY, "line", F.col("step").cast("long").alias("step")).withColumn("_asked", F.lit(True))
    best = best_so_far(_merged(near, asked, [KEY, "line"], params), [KEY, "line"], "step", wins, block=BLOCK)
    found = best.where(F.col("_asked") & (F.col("step") <= F.col("_last"))).select(KEY, "line", "step", F.struct(*wins).alias("_won0"))
    df = points.withColumn("step", F.col("step").cast("long")).join(found, [KEY, "line", "step"]).join(experiments.select(KEY, *params), KEY)
    return df.select(*points.columns, *_in_force(df, params, params, [F.col("_won0")]))


def _event_start(axes: list[Axis]) -> Column:
    """First flat cell an update applies to under the row rule."""
    start = F.when(F.col("axis_pos") == ALWAYS, F.lit(0).cast("long"))
    for k, axis in enumerate(axes):
        start = start.when(F.col("axis_pos") == k, F.col("step") * stride(axes, axis.index))
    return start


def _params_at_cell(
    experiments: DataFrame, updates: DataFrame, axes: list[Axis], params: list[str], cell: Column
) -> DataFrame:
    """Parameters in force at one flat cell per experiment (row rule): an aggregate over the log."""
    place = experiments.select(KEY, *[a.size for a in axes], cell.cast("long").alias("_cell"))
    on = last_entries(updates, axes, params).join(place, KEY).where(_event_start(axes) <= F.col("_cell"))
    won = on.groupBy(KEY).agg(
        *[
            F.max_by(F.when(F.col("param") == p, F.col("value")), F.when(F.col("param") == p, F.col("seq"))).alias(f"_w_{p}")
            for p in params
        ]
    )
    df = experiments.join(won, KEY, "left").withColumn("cell_idx", cell.cast("long"))
    held = {p: F.coalesce(F.col(f"_w_{p}").cast(experiments.schema[p].dataType), F.col(p)) for p in params}
    return df.withColumns(held).drop(*[f"_w_{p}" for p in params])


def params_at_step(
    experiments: DataFrame, updates: DataFrame, axes: list[Axis], params: list[str],
    axis: str | None = None, step: int | None = None,
) -> DataFrame:
    """Parameters in force where a step of an axis starts; without axis, at the first cell."""
    if (axis is None) != (step is None):
        raise ValueError("axis and step go together")
    at = F.lit(0) if axis is None else F.lit(step) * stride(axes, axis)
    return _params_at_cell(experiments, updates, axes, params, at)


def params_at_last_row(
    experiments: DataFrame, updates: DataFrame, axes: list[Axis], params: list[str]
) -> DataFrame:
    """Parameters in force at the last cell of each experiment."""
    return _params_at_cell(experiments, updates, axes, params, F.greatest(num_rows(axes) - 1, F.lit(0)))


def record_updates(
    experiments: DataFrame, log: DataFrame, proposals: DataFrame, axes: list[Axis], params: list[str], spec: list[Param] = ()
) -> DataFrame:
    """The proposals that change a value, as new log rows.

    Proposals are entered in step order, after what the log already holds: the value in force
    before one is that of the last recorded proposal, else the log's at its step, else the base.
    Changing an axis size, a step without an axis or an axis without a step, and proposals out of step order are errors.
    With ``spec``, recorded values are coerced as their parameter's type asks, and checked against it.

    Log and proposals merge in the order of the cells they apply from, the proposals of one cell once; both that and the
    comparison with the proposal before go block by block, however many of them one experiment has.
    """
    names = [n for a in axes for n in (a.size, a.index)]
    refused = [
        (F.col("param").isin(*names), "the size of an axis cannot be updated"),
        (F.col("iterator_code").isNull() != F.col("step_index").isNull(), "axis and step go together"),
    ]
    value = proposals.schema["value"].dataType
    base = F.coalesce(*[F.when(F.col("param") == p, F.col(f"_base_{p}").cast(value)) for p in params], F.lit(None).cast(value))
    own = experiments.select(KEY, *[a.size for a in axes], *[F.col(p).alias(f"_base_{p}") for p in params])
    placed = with_axis_position(_checked(proposals, refused), axes).withColumn("step", F.greatest(F.coalesce("step_index", F.lit(0)), F.lit(0)))
    told = placed.join(own, KEY).select(KEY, "param", "seq", "value", _event_start(axes).alias("_from"), base.alias("_base"))

    # Log and proposals meet at the cells they apply from, a row for each.
    entries = _along_cells(log, experiments, axes, params).select(KEY, "param", F.col("step").alias("_from"), "seq", F.col("value").cast(value).alias("value"))
    asked = told.select(KEY, "param", "_from", F.lit(True).alias("_asked"))
    met = entries.unionByName(asked, allowMissingColumns=True).groupBy(KEY, "param", "_from").agg(
        F.max("_asked").alias("_asked"), F.max("seq").alias("_s"), F.max_by("value", "seq").alias("_v")
    )
    won = met.select(KEY, "param", "_from", "_asked", F.struct(F.col("_s").alias("seq"), F.col("_v").alias("value")).alias("_win"))
    best = best_so_far(won, [KEY, "param"], "_from", ["_win"], block=BLOCK)
    in_log = best.where(F.col("_asked") & (F.col("_from") <= F.col("_last"))).select(KEY, "param", "_from", F.col("_win.value").alias("_logged"))
    held = told.join(in_log, [KEY, "param", "_from"]).select(
        KEY, "param", "seq", "value", "_from", (~F.col("value").eqNullSafe(F.coalesce("_logged", "_base"))).alias("_differs")
    )
    # Until one is recorded, each is compared with the log at its own step. From then on the last recorded one
    # is in force, and a proposal that is not recorded equals it, so the proposal before tells.
    chained = chain(held, [KEY, "param"], "seq", {"_prior": "value", "_came_from": "_from"}, {"_begun": "_differs"})
    ordered = _checked(chained, [(F.col("_came_from") > F.col("_from"), "proposals must be entered in step order")])
    new = ordered.where(F.when(F.col("_begun"), ~F.col("value").eqNullSafe(F.col("_prior"))).otherwise(F.col("_differs")))
    out = proposals.join(new.select(KEY, "param", "seq"), [KEY, "param", "seq"], "left_semi").select(*proposals.columns)
    return sanitized(out, spec) if spec else out


def _checked(df: DataFrame, refused: list[tuple[Column, str]]) -> DataFrame:
    """The same rows; the job fails at the first that is refused."""
    ok = F.lit(True)
    for bad, why in refused:
        ok = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(why)).cast("boolean")).otherwise(ok)
    return df.where(ok)


def sanitized(log: DataFrame, spec: list[Param]) -> DataFrame:
    """Log rows with values as their parameter's type asks (half-even integers, reals rounded); one outside its bounds fails the job.

    The column keeps its type: a bool is 0 or 1, a category stays a text in a log of texts.
    """
    kind = log.schema["value"].dataType
    value, refused = F.raise_error(F.concat(F.lit("parameters not defined: "), F.col("param"))).cast(kind), []
    for p in spec:
        mine = F.col("param") == p.name
        value = F.when(mine, coerced(p, F.col("value")).cast("int" if p.kind == "bool" else p.spark_type).cast(kind)).otherwise(value)
        refused += [(mine & bad, f"invalid parameter: {p.name} {rule}") for bad, rule in rules(p, F.col("value"))]
    return _checked(log.withColumn("value", value), refused)


def trajectory_to_events(trajectories: DataFrame, axes: list[Axis]) -> DataFrame:
    """One event per step of a trajectory (exp_code, dimension, steps: array of (step, updates map))."""
    return trajectories.select(KEY, "dimension", F.explode("steps").alias("s")).select(
        KEY, F.col("dimension").alias("iterator_code"), F.col("s.step").alias("step_index"), F.col("s.updates").alias("updates")
    )


def events_to_trajectory(events: DataFrame, axes: list[Axis], dimension: str) -> DataFrame:
    """Entries of one dimension with their place by step; events without a step are left out.

    A log may hold any number of entries per step, so they stay rows: (key, pos, step, …).
    """
    axis = axes[find_axis(axes, dimension)]
    own = events.where(F.col("iterator_code").isin(axis.size, axis.index) & F.col("step_index").isNotNull())
    placed = positions(own, ["step_index", "seq"], by=[KEY], then=["param"])
    return placed.select(KEY, "pos", F.col("step_index").alias("step"), "seq", "param", "value")
