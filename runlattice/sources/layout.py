"""Reading experiment folders and writing experiment tables.

A folder tree has one folder per experiment, nested codes included, with ``parameters.json``,
``performance_attrs.json``, ``parameter_updates.json``, ``metadata.json``, ``config.json`` and one
``<feature>.csv`` per feature; ``experiment_sets.json`` lies at the root.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlattice.operators.grid import KEY
from runlattice.session import checkpointed, spread

UPDATE_LOG = "array<struct<updates: map<string,string>, iterator_code: string, step_index: int, source_step: string>>"
SET_LIST = "array<struct<code: string, members: array<string>, ordered: boolean, offset: bigint>>"
CHUNK = 1 << 16


def experiment_code(schema: str, number: Column) -> Column:
    """``<schema>_`` and the number, padded to three digits; a negative one is an error."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return F.when(number >= 0, F.concat(F.lit(f"{schema}_"), padded)).otherwise(
        F.raise_error(F.lit("an experiment number must not be negative")).cast("string")
    )


def _code_of(path: Column, root: str) -> Column:
    """Folder of a file, relative to the root."""
    clean = root.rstrip("/").split("://")[-1].split(":")[-1]
    folder = F.regexp_extract(path, rf"\Q{clean}\E/(.+)/[^/]+$", 1)
    return F.url_decode(F.regexp_replace(folder, f"(^|/){KEY}=", "$1"))


def list_experiments(spark: SparkSession, root: str) -> DataFrame:
    """Codes of all experiment folders, from file names alone."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
            _code_of(F.col("path"), root).alias(KEY)
        )
    )
    return files.where(F.col(KEY) != "").distinct()


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
        .select(_code_of(F.col("_metadata.file_path"), root).alias(KEY), F.col("value").alias("text"))
    )


def read_block(spark: SparkSession, root: str, block: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per experiment as a row; ``block`` is the file name without ending."""
    files = _files(spark, root, f"{block}.json")
    parsed = files.withColumn("r", F.from_json("text", schema, {"mode": "FAILFAST"}))
    return parsed.select(KEY, "r.*")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Provenance records as JSON text."""
    return _files(spark, root, "config.json").withColumnRenamed("text", "config_snapshot")


def read_updates(spark: SparkSession, root: str) -> DataFrame:
    """Update logs as rows; ``seq`` is the place in the file, updates are split by parameter."""
    events = _files(spark, root, "parameter_updates.json").select(
        KEY, F.posexplode(F.from_json("text", UPDATE_LOG)).alias("seq", "e")
    )
    return events.select(
        KEY, F.col("seq").cast("long").alias("seq"), "e.iterator_code", "e.step_index", "e.source_step",
        F.explode("e.updates").alias("param", "value"),
    )


def read_features(spark: SparkSession, root: str, feature: str, iterators: list[str]) -> DataFrame:
    """Cells of one feature from its CSV files, with NaN as NULL."""
    schema = ", ".join([*[f"{i} double" for i in iterators], f"{feature} double"])
    rows = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{feature}.csv").csv(root)
        .select("*", _code_of(F.col("_metadata.file_path"), root).alias(KEY))
    )
    value = F.when(~F.isnan(feature), F.col(feature))
    return rows.select(KEY, *[F.bround(i).cast("int").alias(i) for i in iterators], value.alias(feature))


def sets_to_json(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """JSON texts of sets, members in order.

    A set longer than a chunk becomes several objects; all but the first carry their offset.
    """
    part = F.floor(F.col("pos") / chunk)
    packed = sets.groupBy(F.col("set_code").alias("code"), part.alias("_part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", KEY))), lambda m: m[KEY].cast("string")).alias("members"),
        F.first("ordered").alias("ordered"),
    )
    offset = F.when(F.col("_part") > 0, F.col("_part") * chunk).alias("offset")
    return packed.select(F.to_json(F.struct("code", "members", "ordered", offset)).alias("value"))


def sets_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Members of sets given as JSON objects or as one list of them."""
    whole = F.when(F.col(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    return (
        texts.select(F.explode(F.from_json(whole, SET_LIST)).alias("s"))
        .select(
            F.col("s.code").alias("set_code"), F.col("s.ordered").alias("ordered"),
            F.coalesce("s.offset", F.lit(0)).alias("_o"), F.posexplode("s.members").alias("pos", KEY),
        )
        .withColumn("pos", F.col("pos") + F.col("_o"))
        .drop("_o")
    )


def load_sets(spark: SparkSession, root: str, external: DataFrame | None = None) -> DataFrame:
    """Set definitions from the root file, else from an external table of JSON texts."""
    path = f"{root.rstrip('/')}/experiment_sets.json"
    try:
        return sets_from_json(spark.read.option("wholetext", True).text(path))
    except AnalysisException:
        if external is None:
            raise
        return sets_from_json(external)


def new_rows(df: DataFrame, existing: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df if existing is None else df.join(existing.select(*keys).distinct(), keys, "left_anti")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """A stored table, or None before the first write."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_table(
    df: DataFrame, path: str, keys: list[str], partition: list[str] = (), recompute: bool = False, fmt: str = "parquet"
) -> bool:
    """Append rows with new keys; True when something was written.

    With ``recompute`` rows replace those with the same keys: the partitions they touch are
    rewritten from what is kept and what is new, which is cut from the table first.
    """
    spark = df.sparkSession
    old = read_table(spark, path, fmt)
    out = new_rows(df, None if recompute else old, keys)
    if recompute and old is not None:
        kept = old.join(df.select(*keys).distinct(), keys, "left_anti")
        if partition:
            kept = kept.join(df.select(*partition).distinct(), list(partition), "left_semi")
        out = checkpointed(kept.select(*df.columns).unionByName(df))
    if out.isEmpty():
        return False
    writer = out.write.format(fmt).mode("overwrite" if recompute and old is not None else "append")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.save(path)
    return True


def _dealt(out: DataFrame) -> DataFrame:
    """Rows spread over all shuffle partitions, so that a task opens its share of the folders and a folder gets one file.

    A folder of more than CHUNK rows is split over files.
    """
    big = out.groupBy(F.col(KEY).alias("_k")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts")).where("_parts > 1")
    # One row for every CHUNK rows at most.
    marked = out.join(F.broadcast(big), F.col(KEY).eqNullSafe(F.col("_k")), "left")
    part = F.pmod(F.xxhash64(*out.columns), F.coalesce("_parts", F.lit(1)))
    return spread(marked.withColumn("_part", part), KEY, "_part").select(*out.columns)


def write_documents(df: DataFrame, root: str, block: str, recompute: bool = False) -> bool:
    """JSON documents, one folder per experiment; existing ones stay unless recomputed."""
    path = f"{root.rstrip('/')}/{block}"
    old = None if recompute else read_table(df.sparkSession, path, "json")
    out = new_rows(df, old, [KEY])
    if out.isEmpty():
        return False
    writer = _dealt(out).write.mode("overwrite" if recompute else "append")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(KEY).json(path)
    return True


def read_documents(spark: SparkSession, root: str, block: str, schema: str) -> DataFrame:
    """Documents written by ``write_documents``; ``schema`` is that of the other columns."""
    return spark.read.schema(f"{schema}, {KEY} string").json(f"{root.rstrip('/')}/{block}")


def read_feature_files(spark: SparkSession, root: str, feature: str, iterators: list[str]) -> DataFrame:
    """Cells written by ``write_feature_files``."""
    schema = ", ".join([*[f"{i} int" for i in iterators], f"{feature} double", f"{KEY} string"])
    return spark.read.schema(schema).option("header", True).csv(f"{root.rstrip('/')}/{feature}")


def write_feature_files(cells: DataFrame, root: str, feature: str, iterators: list[str], recompute: bool = False) -> bool:
    """CSV cells of a feature, one folder per experiment; a big one is split over files."""
    path = f"{root.rstrip('/')}/{feature}"
    old = None if recompute else read_table(cells.sparkSession, path, "csv")
    out = new_rows(cells.select(KEY, *iterators, feature), old, [KEY])
    if out.isEmpty():
        return False
    writer = _dealt(out).write.mode("overwrite" if recompute else "append").option("header", True)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(KEY).csv(path)
    return True
