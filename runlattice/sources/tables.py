"""Maps star-schema tables to the experiment model.

orders → experiments, lineitem → cells on one axis, events → cells on two axes and
parameter updates, embeddings → kernels, supplier → candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.schema import Axis, Param
from runlattice.session import dealt

LAYER = Axis("n_layers", "layer", 7)
DAY = Axis("n_days", "day", 31)
HOUR = Axis("n_hours", "hour", 24)
STATUSES = ("F", "O", "P")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EXPERIMENT_PARAMS = [
    Param("total", "real", 1000.0, 400000.0, digits=1),
    Param("cust", "int", 10, None),
    Param("priority", "category", vocab=PRIORITIES[:4]),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("exp_code"),
        F.col("o_orderkey").alias("exp_seq"),
        F.col("o_orderstatus").alias("dataset_code"),
        F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One row per measured cell; repeated line numbers are merged, so a key is never hot.

    Few lines repeat a cell, so they are dealt by cell as they are: merged where they are read, a task would hold a row for
    nearly every line of its part of the file.
    """
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("exp_code"), (F.col("l_linenumber") - 1).alias("layer"), "l_quantity", "l_extendedprice", "l_discount"
    )
    return (
        dealt(lines, "exp_code", "layer")
        .groupBy("exp_code", "layer")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.round(F.sum("l_extendedprice"), 2).alias("price"),
            F.max("l_discount").alias("discount"),
        )
    )


def sized_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments with their own axis length; 0 where nothing was measured."""
    sizes = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("exp_code"))
        .agg(F.max("l_linenumber").alias("n_layers"))
    )
    return (
        dealt(experiments(spark, folder), "exp_code")
        .join(sizes.hint("merge"), "exp_code", "left")
        .withColumn("n_layers", F.coalesce("n_layers", F.lit(0)))
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Two-axis experiments: one per user, days by hours."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("exp_code"))
        .agg(F.max(F.dayofmonth("ts")).alias("n_days"))
        .withColumn("n_hours", F.lit(24))
        .select("exp_code", "n_days", "n_hours", *[F.lit(0.0).alias(e) for e in EVENT_TYPES])
    )


def user_cells(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy(
            F.col("user_id").alias("exp_code"),
            (F.dayofmonth("ts") - 1).alias("day"),
            F.hour("ts").alias("hour"),
        )
        .agg(F.round(F.sum("value"), 2).alias("value"), F.count(F.lit(1)).alias("n"))
    )


def updates(spark: SparkSession, folder: str) -> DataFrame:
    return as_updates(table(spark, folder, "events"))


def as_updates(events: DataFrame) -> DataFrame:
    """Mid-run parameter changes. The second of its time says which axis an event is on."""
    k = F.second("ts")
    axis = F.when(k < 27, "n_days").when(k < 54, "hour")
    step = F.when(k < 27, F.dayofmonth("ts") - 1).when(k < 54, F.hour("ts"))
    return events.select(
        F.col("user_id").alias("exp_code"),
        F.col("event_id").alias("seq"),
        axis.alias("iterator_code"),
        step.alias("step_index"),
        F.col("event_type").alias("param"),
        F.col("value"),
    )


def kernels(spark: SparkSession, folder: str, dims: int = 2) -> DataFrame:
    """Embedding coordinates scaled to the unit frame; the label is the model."""
    emb = table(spark, folder, "embeddings")
    raw = emb.select(
        F.col("vec_id").alias("kernel_id"),
        F.col("label").alias("model"),
        *[F.element_at("embedding", d + 1).cast("double").alias(f"v{d}") for d in range(dims)],
    )
    ends = raw.agg(
        *[f(f"v{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def end(name):
        return ends.select(name).scalar()

    return raw.select(
        "kernel_id",
        "model",
        F.lit(1.0).alias("w"),
        *[((F.col(f"v{d}") - end(f"lo{d}")) / (end(f"hi{d}") - end(f"lo{d}"))).alias(f"z{d}") for d in range(dims)],
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as candidate points in the unit square: balance and nation."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("cand_id"),
        ((F.col("s_acctbal") + 1000.0) / 11000.0).alias("z0"),
        (F.col("s_nationkey") / 24.0).alias("z1"),
    )
