"""Hard negatives by Fagin's threshold algorithm over shards of the candidates.

Components are integers, so scores are exact. A shard holds its vectors as one list a dimension, sorted by component. For an
anchor every list is read from the end that its component's sign favours; rows met for the first time are fetched and scored
in full. No row that is still unmet can score more than the threshold: the sum over the lists of the anchor's component times
the last one read. Reading stops when the threshold lies strictly below what the k-th row of every wanted window scores (ties go
to smaller ids, so an equal score could still win), or below the window itself.

The anchors are dealt in blocks, and every block meets every shard: a stated set of queries against all rows. A shard returns
its k best of each window, and the k best of those are the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, partitions, stored

#: Components are floor(SCALE * x).
SCALE = 256
#: Each such row is an anchor.
EVERY = 50
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Vectors of a shard, and anchors of a block, on average.
SHARD, BLOCK = 8192, 2048
#: Entries first read from each list; each further reading doubles what has been read.
FIRST = 32
#: Scaled components stay below this in size; 4096 products of two, a hundred times, fit 63 bits.
LARGEST = 1 << 22
#: Up to such a sum of products doubles are exact.
EXACT = 1 << 53

#: The window of all scores.
EVERYTHING = (-(1 << 63), (1 << 63) - 1)


def shifted(label: Column, vec_id: Column) -> Column:
    """The labels that count: those of ids divisible by 7 go one up, from 9 to 0."""
    return F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v) that take part, with scaled components."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST))
    taking = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(whole, F.lit(False)))
    return taking.select("vec_id", shifted(F.col("label"), F.col("vec_id")).alias("label"), v.alias("v"))


class Shard:
    """Sorted lists of the components of some vectors of one length, and random access to the vectors."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        """`known` is false where the id is null; null ids come after all others at equal scores."""
        by_id = np.lexsort((ids, ~known))  # rows of equal score stand in the order that breaks ties
        self.ids, self.known, self.labels, self.vectors = ids[by_id], known[by_id], labels[by_id], vectors[by_id]
        self._order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self._values = np.ascontiguousarray(np.sort(self.vectors, axis=0).T)
        self._largest = int(np.abs(self.vectors).max(initial=0))
        self._as_double = self.vectors.astype(float)

    def _scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self._largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self._as_double[rows] @ anchor.astype(float)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (least, most) the rows and scores of the first k allowed rows whose score lies in it."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        unmet = allowed.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        at, to = 0, min(FIRST, n)
        while True:
            read = np.zeros(n, bool)
            read[self._order[up, n - to : n - at].ravel()] = True
            read[self._order[down, at:to].ravel()] = True
            if not len(up) and not len(down):
                read[:] = True  # no list says anything: every score is 0
            rows = np.flatnonzero(read & unmet)
            unmet[rows] = False
            if len(rows):
                scores = self._scores(rows, anchor)
                for i, (least, most) in enumerate(windows):
                    held = (scores >= least) & (scores <= most)
                    if held.any():
                        own, got = np.concatenate([found[i][0], rows[held]]), np.concatenate([found[i][1], scores[held]])
                        first = np.lexsort((own, -got))[:k]
                        found[i] = own[first], got[first]
            if to == n or not unmet.any():
                return found
            threshold = int(self._values[up, n - to] @ anchor[up]) + int(self._values[down, to - 1] @ anchor[down])
            if all(threshold < least or len(got) == k and threshold < got[-1] for (least, _), (_, got) in zip(windows, found)):
                return found
            at, to = to, min(2 * to, n)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Shard, Iterator[pa.RecordBatch]]]:
    """Of rows in order (unit, size, anchor) each unit's shard with the batches of its anchors, one unit at a time."""

    def runs() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if b > a:
                    yield tuple(keys[a]), batch.slice(a, b - a)

    ahead = runs()
    item = next(ahead, None)
    while item is not None:
        unit, held = item[0][:2], []
        while item is not None and item[0] == (*unit, 0):
            held.append(item[1])
            item = next(ahead, None)

        def anchors() -> Iterator[pa.RecordBatch]:
            nonlocal item
            while item is not None and item[0] == (*unit, 1):
                yield item[1]
                item = next(ahead, None)

        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            yield Shard(*_vectors(rows)), anchors()
        for _ in anchors():
            pass  # anchors of a length that no vector of this shard has


def _vectors(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (0 where null), whether known, labels, vectors; all vectors of the batch have one length."""
    ids = rows.column(3)
    flat = rows.column(5).flatten().to_numpy(zero_copy_only=False)
    return (
        ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
        rows.column(4).to_numpy(zero_copy_only=False), flat.reshape(rows.num_rows, -1).astype(np.int64),
    )


def _best(candidates: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int, share: tuple[int, int] | None = None) -> DataFrame:
    """Rows (row, window, score, found_id): of each shard the first k of each anchor's windows.

    Without `share`, one window of all scores among rows of the anchor's label; else one for each of its `positives`, from and to
    such hundredths of that score, among rows of other labels. `candidates` have shard and `anchors` block; each anchor's own id is left out.
    """
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cut = candidates.withColumn("block", everywhere).withColumns({"row": F.lit(None).cast("long"), "positives": F.lit(None).cast("array<long>")})
    asked = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    unit = (F.col("shard") * blocks + F.col("block")).cast("long").alias("unit")
    own = [
        rows.select(unit, F.size("v").cast("long").alias("size"), F.lit(kind).alias("anchor"), "vec_id", "label", "v", "row", "positives")
        for kind, rows in enumerate((cut, asked))
    ]
    schema = pa.schema([("row", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("found_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _shards(batches):
            for part in parts:
                ids, known, labels, vectors = _vectors(part)
                out: list[list] = [[], [], [], []]
                for i, (row, positives) in enumerate(zip(part.column(6).to_pylist(), part.column(7).to_pylist())):
                    if share:
                        windows = [(-(-p * share[0] // 100), p * share[1] // 100) for p in positives]
                        allowed = shard.labels != labels[i]
                    else:
                        windows, allowed = [EVERYTHING], shard.labels == labels[i]
                    if known[i]:
                        allowed &= ~shard.known | (shard.ids != ids[i])
                    got = shard.best(vectors[i], allowed, windows, k)
                    for j, (rows, scores) in enumerate(got):
                        out[0] += [row] * len(rows)
                        out[1] += [j] * len(rows)
                        out[2] += scores.tolist()
                        out[3] += [int(x) if y else None for x, y in zip(shard.ids[rows], shard.known[rows])]
                yield arrow_batch(schema, out)

    n = max(partitions(candidates.sparkSession), min(shards * blocks, 100_000))
    dealt = own[0].unionByName(own[1]).repartition(n, "unit").sortWithinPartitions("unit", "size", "anchor")
    return dealt.mapInArrow(run, "row long, window int, score long, found_id long")


def mined(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """Per anchor and positive the first `negatives` negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null or empty vector, or null or non-finite components take no part, nor do vectors with a component
    of 2**14 or more in size, whose scores need not fit a long. Vectors of different lengths have no score together. Repeated rows
    count each by itself: each repeated anchor gives its own rows, and every other row may be found; rows under the anchor's
    own id are none. A null id is no anchor, and comes last among equal scores. A positive found twice has its window twice. An anchor without
    positives, and a positive without negatives, give no rows. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    # Numbered and dealt once and written: a lost task must not deal rows anew.
    numbered = stored(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    is_anchor = F.col("vec_id") % every == 0
    n, asked = numbered.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))
    candidates = numbered.select("vec_id", "label", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    anchors = numbered.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))

    near = _best(candidates, anchors.withColumn("positives", F.lit(None).cast("array<long>")), shards, blocks, positives)
    first = Window.partitionBy("row").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last())
    places = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    wanted = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "found_id", "score"))).alias("found"))  # `positives` a group

    wanted = stored(wanted.withColumn("positives", F.transform("found", lambda p: p["score"])), "negatives-positives")
    again = anchors.join(wanted.select("row", "positives"), "row")
    hard = _best(candidates, again, shards, blocks, negatives, (least, most))
    ranked = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last())
    top = hard.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    named = wanted.select("row", F.posexplode("found").alias("window", "p")).select("row", "window", F.col("p.found_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return top.join(named, ["row", "window"]).join(ids, "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
