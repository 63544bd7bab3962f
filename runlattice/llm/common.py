"""Tables, shared files and small helpers of the operators in this subpackage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.session import shared_folder

#: What a worker process has loaded, by digest: vocabularies and models outlive a task there.
_LOADED: dict[str, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text alone; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def sampled(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Up to n different rows, the first by a hash of their key: (place, row, value), place and row being hashes that order
    them. The hashes are drawn first, so no value but those taken leaves its place."""
    hashes = rows.select(F.xxhash64(key).alias("place"), F.xxhash64(key, value).alias("row"), F.col(value).alias("value"))
    drawn = [r.row for r in hashes.select("place", "row").distinct().orderBy("place", "row").limit(n).collect()]
    return hashes.filter(F.col("row").isin(drawn)).groupBy("place", "row").agg(F.first("value").alias("value"))


def loaded(digest: str, build: Callable[[], Any]) -> Any:
    """The object of this digest, built once in a worker process."""
    if digest not in _LOADED:
        _LOADED[digest] = build()
    return _LOADED[digest]


class Remembered:
    """Byte strings of parts of texts, computed once for many: two generations of bounded size; what is used moves to the
    younger one, and when that is full the older one is forgotten."""

    def __init__(self, compute: Callable[[list[str]], Iterable[bytes]], size: int):
        self._compute, self._half = compute, size // 2
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """Per list the byte strings of its parts, end to end."""
        parts = list(set().union(*lists))
        known = dict(zip(parts, self.each(parts)))
        return [b"".join(map(known.__getitem__, own)) for own in lists]

    def each(self, parts: list[str]) -> list[bytes]:
        """The byte string of each part; no part twice."""
        out = list(map(self._young.get, parts))
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            out[i] = self._old.get(parts[i])
        fresh = [parts[i] for i in missing if out[i] is None]
        computed = iter(self._compute(fresh))
        for i in missing:
            if out[i] is None:
                out[i] = next(computed)
        found = {parts[i]: out[i] for i in missing}
        if len(self._young) + len(found) <= self._half:
            self._young.update(found)
        else:
            self._old, self._young = self._young, found
        return out


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes of a text column, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        upto = min(max(int(np.searchsorted(ends, done + size, "right")), at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = min(upto, batch.num_rows)


def digest_of(*parts: bytes) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(len(part).to_bytes(8, "little"))
        h.update(part)
    return h.hexdigest()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, on storage that executors can't lose."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def splits(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n-1 ascending values that cut the keys into ranges of about equal size; reads the key column alone."""
    if n < 2:
        return []
    found = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in found})


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range that a key lies in: how many cuts are at or below it; null keys lie in the first."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(search(0, len(cuts)))


def store_of(folder: str):
    """File system and path of a shared folder's address, in the driver or a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def new_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses; only names in a committed index count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
