"""The same results delivered batch by batch.

State is the aggregate itself: the last update per (experiment, parameter, axis, step), which is
bounded by the declared axes. Each micro-batch writes the keys it changed under its own number,
so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.operators.grid import KEY
from runlattice.operators.sets import add_new_to_train
from runlattice.session import checkpointed


def latest_updates(log: DataFrame) -> DataFrame:
    """Last entry per (key, parameter, axis, step) of a batch or a stream."""
    return log.groupBy(KEY, "param", "iterator_code", "step_index").agg(F.max(F.struct("seq", "value")).alias("win"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, handle: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "update"):
    """Start a query that writes each micro-batch to its own folder; returns the query."""

    def save(batch: DataFrame, number: int) -> None:
        # What a handler reads of earlier batches is read before this one's folder is written anew.
        out = batch if handle is None else checkpointed(handle(batch, number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(save).start()
    )


def read_latest(spark: SparkSession, path: str, keys: list[str], value: str = "win") -> DataFrame:
    """Newest state of every key over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def stream_updates(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of updates to its end and return a log equal to the batch one."""
    write_batches(latest_updates(log), path, checkpoint).awaitTermination()
    keys = [KEY, "param", "iterator_code", "step_index"]
    state = read_latest(log.sparkSession, path, keys)
    return state.select(*keys, "win.seq", "win.value")


def grow_splits(spark: SparkSession, populated: DataFrame, path: str, checkpoint: str, schema: str):
    """Put newly populated experiments of a stream into train, each once.

    A batch that is run again leaves out what it wrote before, so it writes the same once more.
    """

    def new_members(batch: DataFrame, number: int) -> DataFrame:
        try:
            held = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
            held = held.where(~F.input_file_name().contains(f"/batch={number}/"))
        except AnalysisException as missing:  # the first batch of a new folder
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            held = spark.createDataFrame([], schema)
        return add_new_to_train(held.limit(0), batch.select(KEY).distinct().join(held, KEY, "left_anti"))

    return write_batches(populated, path, checkpoint, new_members, "append")
