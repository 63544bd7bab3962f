"""Loading and saving across memory, local files and external sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY
from runlattice.session import dealt

MEMORY, LOCAL, EXTERNAL = "memory", "local", "external"


def tiered_load(
    keys: DataFrame,
    tiers: dict[str, DataFrame | Callable[[DataFrame], DataFrame]],
    recompute: bool = False,
    debug: bool = False,
    on: list[str] = (KEY,),
) -> tuple[DataFrame, DataFrame]:
    """(found rows with their ``tier``, keys found nowhere).

    Tiers are asked in the order memory, local, external, each only for keys still missing; one
    given as a function gets those keys. Recompute leaves out local, debug leaves out external.

    Keys and tiers are dealt by key and merged, as either may be of any size: no task holds more than its share of them.
    """
    on = list(on)
    skipped = ({LOCAL} if recompute else set()) | ({EXTERNAL} if debug else set())
    missing = dealt(keys.select(*on), *on)
    found = []
    for name in (MEMORY, LOCAL, EXTERNAL):
        if name in skipped or tiers.get(name) is None:
            continue
        source = tiers[name](missing.distinct()) if callable(tiers[name]) else tiers[name]
        hit = source.join(missing.hint("merge"), on, "left_semi")
        found.append(hit.withColumn("tier", F.lit(name)))
        missing = missing.join(dealt(source.select(*on), *on).hint("merge"), on, "left_anti")
    if not found:
        raise ValueError("no tier to load from")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), missing.distinct()


def worth_saving(values: DataFrame, value: str = "value", keys: list[str] = (KEY, "feature")) -> DataFrame:
    """Rows of blocks that have at least one value; empty and all-missing blocks are left out."""
    some = values.groupBy(*keys).agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("_n"))
    return values.join(some.where("_n > 0").select(*keys), list(keys), "left_semi")


def tiered_save(
    blocks: dict[str, DataFrame],
    save_local: Callable[[str, DataFrame], bool],
    push: Callable[[str, DataFrame], bool] | None = None,
    debug: bool = False,
) -> dict[str, str]:
    """Save each block locally, push it only if that wrote something new."""
    done = {}
    for name, df in blocks.items():
        if df.isEmpty():
            done[name] = "empty"
        elif not save_local(name, df):
            done[name] = "present"
        elif push is None or debug:
            done[name] = "saved"
        else:
            done[name] = "pushed" if push(name, df) else "saved"
    return done


def populate(local: DataFrame, external: DataFrame | None = None, dataset: str | None = None, exclude: list[str] | None = ("failed",)) -> DataFrame:
    """Codes known anywhere, of one dataset, without those holding an excluded word."""
    codes = local.select(KEY) if external is None else local.select(KEY).unionByName(external.select(KEY))
    out = codes.distinct()
    if dataset is not None:
        out = out.where(F.col(KEY).contains(f"/{dataset}/") | F.col(KEY).startswith(f"{dataset}/"))
    for word in exclude or ():
        out = out.where(~F.col(KEY).contains(word))
    return out


def pull(source: DataFrame, keys: DataFrame, on: list[str] = (KEY,)) -> tuple[DataFrame, DataFrame]:
    """Rows of a source for the given keys, and the keys it lacks."""
    return source.join(keys.select(*on), list(on), "left_semi"), keys.select(*on).join(source.select(*on), list(on), "left_anti")


def pull_all_missing(keys: DataFrame) -> tuple[None, DataFrame]:
    """An external source without an implementation: everything is missing."""
    return None, keys
