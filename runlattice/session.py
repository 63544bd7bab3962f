"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "runlattice", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, the master, shuffle partition count and checkpoint folder come from
    the submit configuration; nothing set there is overridden.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.sql.shuffle.partitions", "8")
                .config("spark.driver.memory", "12g")
                .config("spark.ui.enabled", "false")
            )
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot key even where that costs the step after the join a shuffle of its own.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Methods above this size are not compiled by HotSpot; plans that wide run better without.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a lost executor loses nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = os.path.join(tempfile.mkdtemp(prefix="runlattice-"), "checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, for steps that do much more work than they read.

    The count is explicit and the key is hashed once more: sized by bytes, a small table would
    end up in one task, and a plain key could be taken as distributed already.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)) if keys else df.repartition(n)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions by key, ahead of steps whose tasks hold a row per key.

    The count is explicit: sized by bytes, many rows that compress well would end up in one task, in each of its hash tables
    and sorts. What joins them by the same keys is dealt the same way and stays so.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, next to the checkpoints all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="runlattice-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
