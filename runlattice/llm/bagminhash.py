"""Near-duplicate documents by BagMinHash: signatures of weighted sets, bands, and a check of the overlap itself.

A document is the multiset of its runs of five words. A shingle of weight w stands for the levels [0, w), discretised to whole
numbers. Each level of each shingle carries a Poisson process of rate one whose points fall on random registers; a register
keeps the least point that falls on it. Two multisets then agree in a register with the probability of their weighted
Jaccard likeness, without bias.

The processes hang in trees: the levels [2^j, 2^(j+1)) have one process of rate 2^j, whose first point is that of one of its
halves, drawn by lot, while the other half starts anew from there. Trees are opened only below the largest register, so heavy
shingles cost little more than light ones. Times are whole numbers of 2^-40, so equal points are equal on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, partitions, slices, stored
from runlattice.llm.graph import components
from runlattice.llm.substrings import _mixed, word_hashes

WORDS, LIKENESS = 5, 0.8
#: A pair of the given likeness of 0.8 meets in one of 24 bands of 5 registers with probability 0.9999.
BANDS, BAND = 24, 5
REGISTERS = BANDS * BAND
#: Texts of a block.
BLOCK = 256

_P = np.uint64(0x9E3779B97F4A7C15)
_ONE, _NEVER = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_NEXT, _REGISTER, _SIDE, _CHILD = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the different runs of words; a text of fewer words is one run, one of none has none."""
    lengths = np.array([len(t.split()) for t in texts], np.int64)
    hashed = word_hashes(b" ".join(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    begin = np.cumsum(lengths) - lengths
    n = len(hashed)
    h = np.zeros(n, np.uint64)
    for j in range(words):  # past the end of the text nothing is added, so short texts are one run
        own = np.zeros(n, np.uint64)
        own[: n - j] = np.where(owner[: n - j] == owner[j:], hashed[j:], 0)
        h = h * _P + own
    place = np.arange(n) - begin[owner]
    whole = (place + words <= lengths[owner]) | (place == 0)
    owner, h = owner[whole], _mixed(h[whole])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def _wait(key: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate one, by key, in units of 2^-40."""
    u = ((key >> np.uint64(11)) + _ONE).astype(np.float64) * 2.0**-53
    return np.floor(-np.log(u) * 2.0**40).astype(np.uint64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of n weighted sets given as rows (set, element's hash, whole weight)."""
    least = np.full(n * registers, _NEVER, np.uint64)
    parts = []
    octave = 0
    while True:
        low = (1 << octave) >> 1
        some = weight > low if octave else weight > 0
        if not some.any():
            break
        key = _mixed(element[some] + np.uint64(octave * int(_P) & 0xFFFFFFFFFFFFFFFF))
        size = max(low, 1)
        time = _wait(key) // np.uint64(size)
        k = len(key)
        parts.append((owner[some], key, time, np.full(k, low, np.int64), np.full(k, size, np.int64), weight[some].astype(np.int64)))
        octave += 1
    if not parts:
        return least.reshape(n, registers)
    nodes = [np.concatenate(x) for x in zip(*parts)]
    while len(nodes[0]):
        last = least.reshape(n, registers).max(1)
        alive = nodes[2] < last[nodes[0]]
        who, key, time, low, size, weight = (x[alive] for x in nodes)
        leaf = size == 1
        at = who[leaf] * registers + (_mixed(key[leaf] ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(least, at, time[leaf])
        after = _mixed(key[leaf] + _NEXT)
        made = [(who[leaf], after, time[leaf] + _wait(after), low[leaf], size[leaf], weight[leaf])]
        if not leaf.all():
            who, key, time, low, size, weight = (x[~leaf] for x in (who, key, time, low, size, weight))
            half = size >> 1
            first = (_mixed(key ^ _SIDE) & _ONE).astype(np.int64)
            for side in (0, 1):
                own = _mixed(key * _P + _CHILD + np.uint64(side))
                start = low + side * half
                then = np.where(first == side, time, time + _wait(own) // half.astype(np.uint64))
                inside = start < weight
                made.append(tuple(x[inside] for x in (who, own, then, start, half, weight)))
        nodes = [np.concatenate(x) for x in zip(*made)]
    return least.reshape(n, registers)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two multisets given as ascending hashes and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - common
    return float(common / either) if either else 0.0


def _signed(rows: DataFrame) -> DataFrame:
    """Of (digest, text) the rows (digest, bands, registers) of all texts that have words: a key per band, a byte per register."""
    schema = pa.schema([("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20, 4096):
                owner, element, weight = shingles([t.as_py().encode() for t in part.column(1)])
                has = np.unique(owner)
                least = signatures(np.searchsorted(has, owner), element, weight, len(has))
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(has), 1))
                for j in range(BAND):
                    key = _mixed(key * _P + least.reshape(-1, BANDS, BAND)[:, :, j])
                lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(has) + 1, BANDS, dtype=np.int32), pa.array(key.view(np.int64).ravel()))
                short = [x.tobytes() for x in (_mixed(least) & np.uint64(255)).astype(np.uint8)]
                yield arrow_batch(schema, [part.column(0).take(pa.array(has)), lists, short])

    return rows.mapInArrow(run, "digest binary, bands array<long>, registers binary")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) of digests those whose texts are alike enough."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def bag(digest: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if digest not in known:
                if len(known) > 256:
                    known.clear()
                known[digest] = shingles([text.encode()])[1:]
            return known[digest]

        for batch in batches:
            for part in slices(batch, 3, 4 << 20, 1024):
                rows = zip(*(c.to_pylist() for c in part.columns))
                good = [overlap(bag(a, of_a), bag(b, of_b)) >= least for a, b, of_a, of_b in rows]
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], schema=schema)

    n = partitions(pairs.sparkSession)
    with_b = pairs.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").repartition(n).mapInArrow(run, "a binary, b binary")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def classes(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Rows (digest, component) of the different texts that are alike to another one: component is the least digest of theirs.

    Texts meet in buckets of equal bands. First each is compared with one pivot in each of its buckets, the text that shares
    most buckets with others, which joins most of a large group at one comparison a text and bucket. Buckets that still hold
    texts of different components are then compared in full, in blocks (`_across`), so no two texts of a bucket stay
    apart uncompared.
    """
    rows = digests(docs)
    signed = stored(_signed(rows).groupBy("digest").agg(F.first(F.struct("bands", "registers")).alias("s")).select("digest", "s.bands", "s.registers"), "near-signed")
    bands = signed.select("digest", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(bands.join(shared, "bucket"), "near-members")
    met = members.groupBy("digest").agg(F.sum(F.col("n") - 1).alias("met"))
    texts = stored(rows.join(met.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "near-texts")
    pivots = members.join(met, "digest").groupBy("bucket").agg(F.max(F.struct("met", "digest")).alias("x")).select("bucket", F.col("x.digest").alias("a"))
    pairs = members.join(pivots, "bucket").filter("a != digest").select("a", F.col("digest").alias("b")).distinct()
    links = stored(_verified(pairs, texts, likeness), "near-links")
    found = components(links)
    labelled = members.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most")
    apart = labelled.join(mixed.select("bucket"), "bucket").select("bucket", "n", "digest", "component")
    more = stored(_across(apart, signed, texts, likeness), "near-more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    return found.select(F.col("node").alias("digest"), "component")


def _across(apart: DataFrame, signed: DataFrame, texts: DataFrame, likeness: float) -> DataFrame:
    """Links between texts of different components in the buckets (bucket, n, digest, component).

    A bucket is cut into blocks, each two blocks meet in one place, and texts are compared there, not as rows. Two texts that
    share several buckets are compared in that of their first common band. Texts whose registers agree so rarely that a
    likeness as asked for would be five standard deviations off aren't opened.
    """
    rarely = REGISTERS * (likeness - 5 * (likeness * (1 - likeness) / REGISTERS) ** 0.5)
    blocks = F.ceil(F.col("n") / BLOCK)
    cut = apart.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "digest", "component")
    whole = dealt.join(signed, "digest").join(texts, "digest").select("bucket", "p", "q", "own", "digest", "component", "bands", "registers", "text")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def compared(key: tuple, rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        own = np.array([r[0] for r in rows])
        bands = np.array([r[3] for r in rows])
        registers = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        band = int(np.flatnonzero((bands == key[0]).all(0))[0])
        group = {r[2]: r[2] for r in rows}
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def root(x: bytes) -> bytes:
            while group[x] != x:
                x = group[x]
            return x

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in bags:
                bags[i] = shingles([rows[i][5].encode()])[1:]
            return bags[i]

        for i in range(len(rows)):
            meet = (registers[i + 1 :] == registers[i]).sum(1) >= rarely
            meet &= ~(bands[i + 1 :, :band] == bands[i, :band]).any(1)
            if key[1] != key[2]:
                meet &= own[i + 1 :] != own[i]
            for j in (np.flatnonzero(meet) + i + 1).tolist():
                x, y = root(rows[i][2]), root(rows[j][2])
                if x != y and overlap(bag(i), bag(j)) >= likeness:
                    group[max(x, y)] = min(x, y)
                    yield rows[i][1], rows[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if held and (links := list(compared(key, held))):
                        yield arrow_batch(schema, list(zip(*links)))
                    key, held = row[:3], []
                held.append(row[3:])
        if held and (links := list(compared(key, held))):
            yield arrow_batch(schema, list(zip(*links)))

    n = partitions(apart.sparkSession)
    return whole.repartition(n, "bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "digest").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of the same text), component_id (least doc_id of its near-duplicate group),
    copies (rows with its text), kept (whether it is the row that stays).

    Null and empty texts are one text; it and texts of white space hold no words and are near to nothing but texts equal to
    them. A null id names a class or group only if no row of it has another. Rows equal in id and text are copies, marked
    alike. Other columns are not read. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))
    named = _named(keyed, classes(docs, likeness))
    return keyed.join(named, "digest").select(
        "doc_id", "class_id", "component_id", "copies", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _named(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Per text (digest): class_id, copies, component (digest) and component_id."""
    own = keyed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    own = own.join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = own.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return own.join(least, "component")


def first_of_each(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The documents, all columns, one row of each near-duplicate group: of the text with the least doc_id, the row with the
    least doc_id (null last; of rows with one id, the least by a hash of all columns). Texts without words all stay as
    one row per different text."""
    whole = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"), F.struct("*").alias("row"))
    keyed = whole.select("digest", F.col("row.doc_id").cast("long").alias("doc_id"))
    named = stored(_named(keyed, classes(docs, likeness)), "near-classes")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("no_id"), "class_id", "digest")).alias("best"))
    staying = best.select("best.digest")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), F.xxhash64("row").alias("h"))
    one = whole.join(staying, "digest", "left_semi").groupBy("digest").agg(F.min_by("row", order).alias("row"))
    return one.select([F.col("row").getField(c).alias(c) for c in docs.columns])
