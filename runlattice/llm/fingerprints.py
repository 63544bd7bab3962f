"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers, by hash, stands at one of its two ends. That depends
on the k-mer alone, so two texts that share a passage choose the same anchors in it, whatever stands around. At least one of
any k - s + 1 neighbours is chosen, 2 / (k - s + 1) of all on average.

A fingerprint has two parts, for long and for short k-mers: the least anchors of the whole text by hash, each with its place. Two of
them are alike by the share of the least anchors of their union that both have, in the same order of places. Both are taken by the
same kind of k-mers: the short ones if either text has few long ones.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, partitions, range_of, slices, splits, texts

#: Lengths of k-mers and their inner s-mers, of both kinds; two texts of which one has fewer long anchors than FEW are compared by short ones.
LONG_MERS, SHORT_MERS, FEW = (16, 6), (6, 3), 16
#: Anchors kept in each part of a fingerprint.
SIZE = 64
#: The bit that tells a short anchor's hash, so that they stand behind the long ones.
KIND = 1 << 31

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _mers(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n code points."""
    m = len(codes) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * _P + codes[j : j + m]
    return _mixed(h)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def syncmers(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the closed syncmers of a run of code points."""
    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = _mers(codes, s)
    least = _least(inner, k - s + 1)
    n = len(least)
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    # s-mers that cover the k-mer stand for it
    h = np.full(len(at), k, np.uint64)
    for j in [*range(0, k - s, s), k - s]:
        h = h * _P + inner[at + j]
    return at, _mixed(h)


def sketches(batch: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the least anchors by hash, ascending, the long ones first, and the place where each stands first."""
    lengths = np.array([len(t) for t in batch], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(batch).encode("utf-32-le"), "<u4").astype(np.uint64)
    keys, places = [], []
    for (k, s), kind in ((LONG_MERS, 0), (SHORT_MERS, KIND)):
        at, h = syncmers(codes, k, s)
        owner = np.searchsorted(starts + lengths, at, "right")
        within = at - starts[owner] if len(at) else at
        whole = within + k <= lengths[owner] if len(at) else np.empty(0, bool)
        keys.append(owner[whole].astype(np.uint64) << np.uint64(32) | h[whole] >> np.uint64(33) | np.uint64(kind))
        places.append(within[whole])
    key, first = np.unique(np.concatenate(keys), return_index=True)
    place, h = np.concatenate(places)[first], key.astype(np.uint32)
    # borders of the parts, two a text
    ends = np.append(np.searchsorted(key, np.arange(2 * len(batch), dtype=np.uint64) << np.uint64(31)), len(key))
    out = []
    for i, text in enumerate(batch):
        a, middle, b = ends[2 * i : 2 * i + 3]
        if a == b and text:  # too short for any anchor: the whole text is one
            own = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little") | KIND
            out.append((np.array([own], np.uint32), np.zeros(1, np.int64)))
        else:
            kept = np.r_[a : min(middle, a + SIZE), middle : min(b, middle + SIZE)]
            out.append((h[kept], place[kept]))
    return out


def packed(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of hash and place of each anchor, as little-endian unsigned 32-bit numbers."""
    return base64.b64encode(np.stack([sketch[0], sketch[1].astype(np.uint32)], 1).astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two texts without anchors (both empty) are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    middle = [int(np.searchsorted(x[0], KIND)) for x in (a, b)]
    part = slice(0, middle[0]), slice(0, middle[1])
    if min(middle) < FEW:
        part = slice(middle[0], None), slice(middle[1], None)
    a, b = (a[0][part[0]], a[1][part[0]]), (b[0][part[1]], b[1][part[1]])
    either = np.unique(np.concatenate([a[0], b[0]]))[:SIZE]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    near = a[0][i] <= either[-1]
    i, j = i[near], j[near]
    tails: list[int] = []  # longest run of shared anchors whose places rise in both
    for place in b[1][j[np.lexsort((b[1][j], a[1][i]))]].tolist():
        at = bisect_right(tails, place)
        tails[at : at + 1] = [place]
    return len(tails) / len(either)


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text): ranges of doc_id, in descending order inside each, one shuffle in all.

    The row that follows a range's last one comes along as guest: the first row of the next lower range that has any;
    after the lowest one, the first of all. There are at most as many guests as ranges.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    n = 4 * partitions(spark)
    cuts = splits(rows, "doc_id", n)
    bucket = range_of(F.col("doc_id"), cuts)
    tops = [(r.bucket, r.top) for r in rows.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()]
    guests = spark.createDataFrame([(top, to) for (_, top), (to, _) in zip(tops, tops[1:] + tops[:1])], "top long, visits int")
    places = F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("visits").alias("bucket"), F.lit(True).alias("guest")))
    return (
        rows.join(F.broadcast(guests), rows.doc_id.eqNullSafe(guests.top), "left")
        .select(F.explode(F.filter(places, lambda p: p.bucket.isNotNull())).alias("p"), "doc_id", "text")
        .select("p.bucket", "p.guest", "doc_id", "text")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike these and the next document's are.

    The next document is the one with the next smaller doc_id, after the last one the first; rows with one id follow each
    other by text, null ids come last. A single document follows itself. Null texts are empty: such a row has an empty
    fingerprint. Texts too short for an anchor have one of their whole. Other columns are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
        + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of its range so far, which waits for the one that follows
        for batch in batches:
            for part in slices(batch, 3, 1 << 20, 512):
                columns = [c.to_pylist() for c in part.columns]
                rows = held + list(zip(*columns, sketches(columns[3])))
                held, ready = [], []
                for i, row in enumerate(rows):
                    if row[1]:
                        continue
                    if i + 1 == len(rows):
                        held = [row]
                    else:
                        ready.append((row, rows[i + 1]))
                if not ready:
                    continue
                new = [edited(row[3], after[3]) for row, after in ready]
                got = sketches(new)
                yield arrow_batch(
                    schema,
                    [
                        [row[2] for row, _ in ready],
                        [len(row[3]) for row, _ in ready],
                        [hashlib.sha256(t.encode()).hexdigest() for t in new],
                        [packed(row[4]) for row, _ in ready],
                        [packed(x) for x in got],
                        [likeness(row[4], x) for (row, _), x in zip(ready, got)],
                        [likeness(row[4], after[4]) for row, after in ready],
                    ],
                )

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInArrow(run, kinds)
