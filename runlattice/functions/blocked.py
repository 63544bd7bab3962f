"""Ordered operations that stay parallel when one key holds most of the rows.

A plain window puts every row of a key into one task. The functions here cut the order
into blocks, work inside each block, and carry one summary row per block across.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def _all_known(keys: list[str]) -> Column:
    """The keys a join would ask for anyway; asked for beforehand, both of its sides are the same plan."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def positions(
    df: DataFrame,
    order: list[str],
    by: list[str] = (),
    name: str = "pos",
    block: int = BLOCK,
    then: list[str] = (),
) -> DataFrame:
    """0-based rank of each row in ``order`` (then ``then``), per ``by`` or over the whole table.

    Order columns that are cut must be integers: the last one always, and with two of them the
    first one too. Only block counts meet in one place; rows are ranked inside a block.
    """
    by, order, then = list(by), list(order), list(then)
    if len(order) > 2:
        raise ValueError("order by at most two columns; further ones go into `then`")
    lead, last = order[:-1], order[-1]
    keyed = df.withColumn("_blk", _block(last, block))
    if lead:
        keyed = keyed.withColumn("_top", _block(lead[0], block))
    else:
        keyed = keyed.withColumn("_top", F.lit(0).cast("long"))
    keys = by + ["_top"] + lead + ["_blk"]
    past = (Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inner = Window.partitionBy(*by, "_top").orderBy(*lead, "_blk").rowsBetween(*past)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(inner), F.lit(0)).alias("_off"))
    if lead:
        tops = keyed.groupBy(*by, "_top").agg(F.count(F.lit(1)).alias("_n"))
        outer = Window.partitionBy(*by).orderBy("_top").rowsBetween(*past)
        starts = tops.select(*by, "_top", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_start"))
        offsets = offsets.join(starts, by + ["_top"]).withColumn("_off", F.col("_off") + F.col("_start")).drop("_start")
    inside = Window.partitionBy(*keys).orderBy(last, *then)
    return (
        keyed.join(offsets, keys)
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_blk", "_top", "_off")
    )


def shuffled_positions(df: DataFrame, key: str, seed: int, name: str = "pos", total: str = "n_rows") -> DataFrame:
    """0-based rank under a reproducible shuffle: order by md5(seed, key); ``total`` is the row count.

    Digests spread evenly, so their first four hex digits are a fair block.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_h", digest).withColumn("_p", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias(total)
    )
    inside = Window.partitionBy("_p").orderBy("_h", key)
    return (
        hashed.join(offsets, "_p")
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_h", "_p", "_off")
    )


def lag_dense(
    df: DataFrame, by: list[str], idx: str, columns: dict[str, str], k: int, block: int = BLOCK
) -> DataFrame:
    """Value ``k`` rows earlier where ``idx`` runs 0, 1, 2, … per key; NULL for the first k.

    Each block also gets the last k rows of the block before it, so one shuffle by
    (key, block) is enough and no key is bigger than a block.
    """
    if k < 1 or k >= block:
        raise ValueError("lag must be at least 1 and shorter than a block")
    own = _block(idx, block)
    home = df.withColumn("_own", own)
    tail = F.col(idx) % F.lit(block) >= F.lit(block - k)
    copies = F.when(tail, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))
    spread = home.withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*by, "_blk").orderBy(idx)
    lagged = spread.select(
        "*", *[F.lag(F.col(src), k).over(w).alias(out) for out, src in columns.items()]
    )
    return lagged.where(F.col("_blk") == F.col("_own")).drop("_own", "_blk")


def chain(df: DataFrame, by: list[str], order: str, prior: dict[str, str], begun: dict[str, str], block: int = BLOCK) -> DataFrame:
    """What came before each row, for an integer order with gaps; ties are not allowed.

    ``prior`` names columns for the value of another column in the row before, ``begun`` for whether a flag was set in any.
    """
    keys = [*by, "_blk"]
    keyed = df.withColumn("_blk", _block(order, block)).where(_all_known(keys)).repartition(*keys)
    ends = keyed.groupBy(*keys).agg(
        *[F.max_by(c, order).alias(f"_e{name}") for name, c in prior.items()], *[F.max(c).alias(f"_e{name}") for name, c in begun.items()]
    )
    along = Window.partitionBy(*by).orderBy("_blk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, *[F.lag(f"_e{name}").over(along).alias(f"_c{name}") for name in prior], *[F.max(f"_e{name}").over(before).alias(f"_c{name}") for name in begun]
    )
    w = Window.partitionBy(*keys).orderBy(order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    told = keyed.join(carry, keys).withColumn("_first", F.row_number().over(w) == 1)
    lagged = {name: F.when(F.col("_first"), F.col(f"_c{name}")).otherwise(F.lag(c).over(w)) for name, c in prior.items()}
    set_ = {name: F.coalesce(F.greatest(F.max(c).over(earlier), F.col(f"_c{name}")), F.lit(False)) for name, c in begun.items()}
    return told.withColumns(lagged | set_).drop("_blk", "_first", *[f"_c{name}" for name in (*prior, *begun)])


def lag_sparse(df: DataFrame, by: list[str], order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Value of the row before, for an integer order with gaps; ties are not allowed."""
    return chain(df, by, order, {name: value}, {}, block)


def best_so_far(df: DataFrame, by: list[str], at: str, wins: list[str], same: dict[str, str] = {}, block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Each struct (seq, value) in ``wins`` replaced by the one of the greatest seq up to and including the row, in the order of
    the integer ``at``, per ``by``; ``at`` is unique there. ``same`` names columns for the greatest value of another column in the
    row's block. Adds ``_blk`` and the last place in it, ``_last``; rows of one (by, _blk) stay together. Rows without a key or place
    are left out.

    A block hands the winner it ends with to those after it, so one row per block meets in one place. Blocks and their ends read the
    same columns, so that Spark shuffles the rows once for both.
    """
    keys = [*by, "_blk"]
    keyed = df.withColumn("_blk", _block(at, block)).where(_all_known(keys)).repartition(*keys)
    tops = keyed.groupBy(*keys).agg(
        *[F.max(f"{w}.seq").alias(f"_s_{w}") for w in wins], *[F.max_by(f"{w}.value", f"{w}.seq").alias(f"_v_{w}") for w in wins],
        F.max(at).alias("_last"), *[F.max(c).alias(name) for name, c in same.items()],
    )
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(
        *keys, "_last", *same, *[F.max(F.struct(F.col(f"_s_{w}").alias("seq"), F.col(f"_v_{w}").alias("value"))).over(before).alias(f"_c_{w}") for w in wins]
    )
    inside = Window.partitionBy(*keys).orderBy(at)
    return (
        keyed.join(carry, keys)
        .withColumns({w: F.greatest(F.max(w).over(inside), F.col(f"_c_{w}")) for w in wins})
        .drop(*[f"_c_{w}" for w in wins])
    )
