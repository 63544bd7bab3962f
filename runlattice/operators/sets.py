"""Selections, named sets, fits, splits, folds and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.functions.blocked import positions, shuffled_positions
from runlattice.operators.grid import KEY

# Step names a provenance record may carry.
SOURCES = ("discovery_step", "exploration_step", "inference_step", "adaptation_step", "sobol_step")


def select(experiments: DataFrame, predicate: Column) -> DataFrame:
    """Experiments satisfying a predicate; ``exp_seq`` carries the dataset order."""
    return experiments.where(predicate).select(KEY, "exp_seq")


def select_set(experiments: DataFrame, code: Column, predicate: Column, ordered: bool = False) -> DataFrame:
    """Members (set_code, ordered, pos, key) of the experiments satisfying a predicate."""
    chosen = experiments.where(predicate).select(code.alias("set_code"), KEY, "exp_seq")
    ranked = positions(chosen, ["exp_seq"], by=["set_code"])
    return ranked.select("set_code", F.lit(ordered).alias("ordered"), "pos", KEY)


def append_to_sets(sets: DataFrame, additions: DataFrame) -> DataFrame:
    """Add (set_code, key, exp_seq) rows at the end of their sets.

    Members already there stay as they are; a set that does not exist is an error.
    """
    ends = sets.groupBy("set_code").agg(F.max("pos").alias("_end"), F.first("ordered").alias("ordered"))
    fresh = additions.groupBy("set_code", KEY).agg(F.min("exp_seq").alias("exp_seq"))
    fresh = fresh.join(sets.select("set_code", KEY), ["set_code", KEY], "left_anti")
    ranked = positions(fresh, ["exp_seq"], by=["set_code"], name="_r").join(ends, "set_code", "left")
    known = F.when(
        F.col("_end").isNull(), F.raise_error(F.concat(F.lit("unknown set: "), F.col("set_code"))).cast("bigint")
    ).otherwise(F.col("_end") + 1 + F.col("_r"))
    return sets.unionByName(ranked.select("set_code", "ordered", known.alias("pos"), KEY))


def window(sets: DataFrame, k: Column | int) -> DataFrame:
    """The first k members of ordered sets; a batch set is an error."""
    need = F.when(F.col("ordered"), True).otherwise(
        F.raise_error(F.concat(F.lit("not an ordered set: "), F.col("set_code"))).cast("boolean")
    )
    return sets.where(need & (F.col("pos") < k))


def fit_at(sets: DataFrame, index: Column | int) -> DataFrame:
    """Members of ordered sets before the one at ``index``."""
    return window(sets, index)


def fit_codes(parts: list[DataFrame]) -> DataFrame:
    """Ordered union of (windowed) sets; a repeated experiment keeps its first place."""
    tagged = [p.select(KEY, F.lit(i).alias("part"), F.col("pos").alias("_p")) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    first = every.groupBy(KEY).agg(F.min_by("_p", "part").alias("_p"), F.min("part").alias("part"))
    return positions(first, ["part", "_p"], then=[KEY]).select(KEY, "pos")


def dataset_codes(experiments: DataFrame) -> DataFrame:
    """Distinct dataset codes with the place each was first seen."""
    return (
        experiments.where("dataset_code IS NOT NULL").groupBy("dataset_code").agg(F.min("exp_seq").alias("first_seen"))
    )


def split(
    codes: DataFrame, val: float = 0.0, test: float = 0.0, seed: int = 0, preset: DataFrame | None = None
) -> DataFrame:
    """(key, split) with kept preset rows and the rest shuffled into test, val and train.

    Sizes are rounded half to even; with presets and no sizes the rest stays unassigned.
    """
    free = codes.select(KEY)
    if preset is not None:
        free = free.join(preset.select(KEY), KEY, "left_anti")
        if val == 0 and test == 0:
            return preset.select(KEY, "split")
    n = F.col("n_rows")
    n_test = F.bround(n * F.lit(float(test))).cast("long")
    share = val / (1.0 - test) if test < 1 else 0.0
    n_val = F.bround((n - n_test) * F.lit(float(share))).cast("long")
    ranked = shuffled_positions(free, KEY, seed)
    named = ranked.select(
        KEY,
        F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_val, "validation").otherwise("train").alias("split"),
    )
    return named if preset is None else preset.select(KEY, "split").unionByName(named)


def add_new_to_train(splits: DataFrame, populated_keys: DataFrame) -> DataFrame:
    """Put experiments that are in no split yet into train."""
    new = populated_keys.select(KEY).join(splits.select(KEY), KEY, "left_anti")
    return splits.unionByName(new.select(KEY, F.lit("train").alias("split")))


def split_by_tag(experiments: DataFrame, tags: dict[str, list[str]], strict: bool = True) -> DataFrame:
    """Splits by dataset code; a split no experiment falls into is an error when strict."""
    name = reduce(
        lambda acc, t: acc.when(F.col("dataset_code").isin(*t[1]), t[0]), list(tags.items()), F.when(F.lit(False), "")
    )
    out = experiments.select(KEY, name.alias("split")).where("split IS NOT NULL")
    if strict:
        found = {r["split"] for r in out.select("split").distinct().collect()}
        empty = [s for s in tags if s not in found]
        if empty:
            raise ValueError(f"no experiment matches split {', '.join(empty)}")
    return out


def split_sizes(splits: DataFrame) -> DataFrame:
    """Rows per split, zeros included."""
    names = ("train", "validation", "test")
    counts = splits.agg(*[F.count_if(F.col("split") == s).alias(s) for s in names])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in names])).alias("r")
    ).select("r.split", "r.n")


def folds(codes: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """(key, fold): round robin over a shuffle; without k, or k at least n, one fold each."""
    ranked = shuffled_positions(codes.select(KEY), KEY, seed)
    if k is None:
        return ranked.select(KEY, F.col("pos").alias("fold"))
    return ranked.select(KEY, F.when(F.lit(k) >= F.col("n_rows"), F.col("pos")).otherwise(F.col("pos") % max(2, k)).alias("fold"))


def parse_provenance(df: DataFrame, snapshot: str = "config_snapshot") -> DataFrame:
    """Typed view of a JSON snapshot: source, seed, origin set and position, other settings.

    A source outside the vocabulary and an origin that is no pair stay in the settings, so
    nothing is lost.
    """
    entries = F.from_json(snapshot, "map<string,string>")
    source = F.get_json_object(snapshot, "$.source")
    origin = F.from_json(F.get_json_object(snapshot, "$.origin"), "array<string>")
    good_source = F.coalesce(source.isin(*SOURCES), F.lit(False))
    good_origin = F.coalesce(F.size(origin) == 2, F.lit(False))
    rest = F.map_filter(
        entries,
        lambda k, v: ~((k == "seed") | ((k == "source") & good_source) | ((k == "origin") & good_origin)),
    )
    return df.withColumns(
        {
            "source": F.when(good_source, source),
            "seed": F.get_json_object(snapshot, "$.seed").cast("long"),
            "origin_set": F.when(good_origin, F.get(origin, F.lit(0))),
            "origin_pos": F.when(good_origin, F.get(origin, F.lit(1)).cast("long")),
            "settings": rest,
        }
    )


def fit_from_provenance(parsed: DataFrame, sets: DataFrame) -> DataFrame:
    """How many members of its origin set each experiment was generated under.

    The prefix of an experiment at position p is the set's members with pos < p, so it is
    given by (origin_set, n_members); listing them all would be quadratic in the set.
    Without a position it is the whole set. ``fit_members`` lists one experiment's.
    """
    size = sets.groupBy("set_code").agg(F.count(F.lit(1)).alias("_size"))
    return parsed.join(size, parsed["origin_set"] == size["set_code"]).select(
        KEY, "origin_set", F.least(F.coalesce("origin_pos", "_size"), "_size").alias("n_members")
    )


def fit_members(fits: DataFrame, sets: DataFrame, exp_code) -> DataFrame:
    """Members of the prefix one experiment was generated under."""
    one = fits.where(F.col(KEY) == F.lit(exp_code)).select("origin_set", "n_members")
    return sets.join(one, sets["set_code"] == one["origin_set"]).where("pos < n_members").select(sets[KEY], "pos")


