"""Exact substring dedup over words, by seed and extend.

Seeds are winnowed word grams: of the grams inside any window of `LENGTH` words the one of least hash is its anchor, so equal
windows have equal anchors at the same place. Documents meet on anchors: a row per chosen gram goes to the task of its
hash, with short hashes of the windows it anchors, which tell how far two occurrences agree to the left and to the right. Of
the windows that agree, all but the earliest are repeats; repeats that touch make up the maximal ones, and the words they
cover go.

Before anything is shuffled, a task removes repeats within what it has read, so a passage comes once per task however often it
stands there, and no anchor gathers more rows than there are different windows around it in each task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, partitions, slices

#: Words of a window; of a gram; grams in a window.
LENGTH, GRAM = 20, 5
GRAMS = LENGTH - GRAM + 1
#: Bytes of text that a task compares at once before the shuffle, and windows that it compares at once after it.
TEXT_BYTES, WINDOWS = 16 << 20, 2_000_000
#: Bytes of a window's hash beside the 64 bits of its anchor.
HASH_BYTES = 5

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self, base: int):
        self._bases = [np.uint64(base), np.uint64(pow(base, -1, 1 << 64))]
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self._tables[0]) < n:
            for k, table in enumerate(self._tables):
                self._tables[k] = np.concatenate([table, table * table[-1] * self._bases[k]])
        return [t[:n] for t in self._tables]


_POWERS = _Powers(0xD6E8FEB86659FD93)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word, in order."""
    codes = np.frombuffer(text, np.uint8)
    gap = np.ones(len(codes) + 2, bool)
    gap[1:-1] = _SPACE[codes]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[end] - sums[begin]) * down[begin])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * _P + words[j : j + m]
    return _mixed(h)


def windows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of the word sequence its hash, its anchor's place and its anchor's hash."""
    if len(words) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = _grams(words, GRAM)
    at = np.arange(len(grams), dtype=np.uint64)
    ranked = (grams & ~_PLACE) | (at & _PLACE)  # ties: the leftmost
    least, width = ranked, 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if GRAMS > width:
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
    n = len(least)
    place = (at[:n] + ((least - at[:n]) & _PLACE)).astype(np.int64)
    whole = np.zeros(n, np.uint64)
    for j in [*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
        whole = whole * _P + grams[j : j + n]
    return _mixed(whole), place, grams[place]


def _spans(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts of one owner, both ascending: owner, first start, number."""
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return owner[at], starts[at], np.diff(np.append(at, len(starts)))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary array: the rows of `values` (bytes), the first counts[0] of them in the first element, and so on."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.shape[1], out=offsets[1:])
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _span_rows(owner: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Per owner its runs as pairs of 32-bit numbers."""
    pairs = np.stack([first, number], 1).astype("<i4").view(np.uint8).reshape(len(first), 8)
    who, counts = np.unique(owner, return_counts=True)
    return who, _binary(pairs, counts)


_FOUND = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int32()), ("place", pa.int32()), ("slots", pa.int32()), ("data", pa.binary())])
_REPEATS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int32()), ("data", pa.binary())])


def _seeds(ids: np.ndarray, hashes: np.ndarray, batch: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of a part of the documents: repeats inside it, as runs (slots 0), and its anchors."""
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    sequences = []
    some: list[bytes] = []
    for k, i in enumerate(order):
        some.append(batch[i])
        if k + 1 == len(order) or sum(map(len, some)) >= 1 << 18:
            sequences += np.split(word_hashes(b" ".join(some)), np.cumsum([len(t.split()) for t in some])[:-1])
            some = []
    lengths = np.array([len(x) for x in sequences], np.int64)
    begin = np.cumsum(lengths) - lengths
    whole, anchor, gram = windows_of(np.concatenate(sequences)) if len(sequences) else windows_of(np.empty(0, np.uint64))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    own = np.flatnonzero(owner[: len(whole)] == owner[LENGTH - 1 : LENGTH - 1 + len(whole)]) if len(whole) else np.empty(0, np.int64)
    if not len(own):
        return
    # Rows equal in id and text are one document: their windows are at the same place of it.
    same = np.zeros(len(ids), np.int64)
    same[1:] = np.cumsum((ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))
    by_hash = own[np.argsort(whole[own], kind="stable")]  # inside one hash still in order
    h, doc, place = whole[by_hash], same[owner[by_hash]], by_hash - begin[owner[by_hash]]
    starts = np.ones(len(h), bool)
    starts[1:] = h[1:] != h[:-1]
    head = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    again = (doc != doc[head]) | (place != place[head])
    repeated = np.zeros(len(whole), bool)
    repeated[by_hash[again]] = True
    twin = np.zeros(len(whole), bool)  # the first one's windows in another row equal to it
    twin[by_hash[~again & ~starts]] = True
    gone = np.flatnonzero(repeated)
    if len(gone):
        who, data = _span_rows(*_spans(gone - begin[owner[gone]], owner[gone]))
        n = len(who)
        key = _mixed(ids[who].astype(np.uint64) ^ hashes[who].astype(np.uint64)).view(np.int64)
        yield arrow_batch(_FOUND, [key, ids[who], hashes[who], np.zeros(n, np.int32), np.zeros(n, np.int32), data])
    left = own[~repeated[own] & ~twin[own]]
    if len(left):
        at, who = anchor[left], owner[left]
        new = np.ones(len(left), bool)
        new[1:] = (at[1:] != at[:-1]) | (who[1:] != who[:-1])
        head = np.flatnonzero(new)
        slots = np.bitwise_or.reduceat(np.int32(1) << (at - left).astype(np.int32), head)
        data = _binary(whole[left].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES], np.diff(np.append(head, len(left))))
        doc = who[head]
        yield arrow_batch(_FOUND, [gram[left[head]].view(np.int64), ids[doc], hashes[doc], (at[head] - begin[doc]).astype(np.int32), slots, data])


def _extend(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the anchors with one hash, the windows that are not the earliest of their kind; runs found before go on as they are."""
    table = pa.Table.from_batches(rows).combine_chunks()
    key, ids, hashes, place, slots = (table.column(i).to_numpy() for i in range(5))
    known = np.flatnonzero(slots == 0)
    if len(known):
        yield arrow_batch(_REPEATS, [ids[known], hashes[known], table.column(5).take(pa.array(known)).combine_chunks()])
    seed = np.flatnonzero(slots)
    _, group, size = np.unique(key[seed], return_inverse=True, return_counts=True)
    seed = seed[size[group] > 1]
    if not len(seed):
        return
    seed = seed[np.lexsort((place[seed], hashes[seed], ids[seed]))]
    key, ids, hashes, place, slots = key[seed], ids[seed], hashes[seed], place[seed], slots[seed]
    data = table.column(5).take(pa.array(seed)).combine_chunks()
    bits = (slots[:, None] >> np.arange(GRAMS - 1, -1, -1)) & 1 == 1  # from the leftmost window to the rightmost
    row, column = np.nonzero(bits)
    slot = GRAMS - 1 - column
    values = np.zeros((len(row), 8), np.uint8)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[np.frombuffer(data.buffers()[1], np.int32)[data.offset] :]
    values[:, :HASH_BYTES] = raw[: len(row) * HASH_BYTES].reshape(-1, HASH_BYTES)
    window = _mixed(key.view(np.uint64)[row] ^ _mixed(values.view("<u8").ravel() << np.uint64(5) | slot.astype(np.uint64)))
    order = np.argsort(window, kind="stable")  # inside one kind still by document and place
    window = window[order]
    starts = np.ones(len(window), bool)
    starts[1:] = window[1:] != window[:-1]
    head = row[order[np.flatnonzero(starts)[np.cumsum(starts) - 1]]]
    own = row[order]  # a row equal in id and text is the same document, in another part
    other = (ids[own] != ids[head]) | (hashes[own] != hashes[head]) | (place[own] != place[head])
    again = np.sort(order[other])
    if not len(again):
        return
    at = row[again]
    start = place[at] - slot[again]
    document = np.zeros(len(ids), np.int64)
    document[1:] = np.cumsum((ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))
    sort = np.lexsort((start, document[at]))
    who, data = _span_rows(*_spans(start[sort], document[at][sort]))
    first = np.searchsorted(document, who)
    yield arrow_batch(_REPEATS, [ids[first], hashes[first], data])


def _removed(data: list[bytes], n_words: int) -> np.ndarray:
    """Which words the windows cover."""
    pairs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in data])
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
    return np.cumsum(change)[:-1] > 0


def repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc, text_hash, data): runs of repeated windows, several rows for a document."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, 2):
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), (t.as_py().encode() for t in part.column(2))))
                held += rows
                size += sum(len(r[2]) for r in rows)
                if size >= TEXT_BYTES:
                    yield from _seeds(*_columns(held))
                    held, size = [], 0
        if held:
            yield from _seeds(*_columns(held))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(5).nbytes // HASH_BYTES
            if size < WINDOWS:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # rows of the last key may go on in the next batch
            if cut or len(held) > 1 and held[-2].column(0)[-1].as_py() != key[-1]:
                held[-1:] = [batch.slice(0, cut)] if cut else []
                yield from _extend(held)
                held = [batch.slice(cut)]
                size = held[0].column(5).nbytes // HASH_BYTES
        if held:
            yield from _extend(held)

    found = docs.mapInArrow(seed, "key long, doc long, text_hash int, place int, slots int, data binary")
    return found.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(extend, "doc long, text_hash int, data binary")


def _columns(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), [r[2] for r in rows]


def _keys() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.hash(text).alias("text_hash"), text.alias("text")]


def _copies(docs: DataFrame) -> DataFrame:
    """Keys of the rows whose whole text stands in an earlier row too; a text with many copies gathers nothing."""
    small = docs.select(*_keys()[:2], F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))
    first = small.groupBy("digest").agg(F.min(F.struct("doc", "text_hash")).alias("first"), F.max(F.struct("doc", "text_hash")).alias("last"))
    later = small.join(first.filter("first != last").select("digest", "first"), "digest").filter(F.struct("doc", "text_hash") != F.col("first"))
    return later.select("doc", "text_hash", F.lit(True).alias("copy")).distinct()


def _with_repeats(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows (text, copy, runs, more): whether the whole text stands earlier, else all runs of repeated windows of its
    document, which are as long as the document at most.

    Copies are known first, so only one of each text seeds. The texts are dealt out once, for both joins.
    """
    keyed = docs.select(*_keys(), *more)
    known = keyed.join(_copies(docs), ["doc", "text_hash"], "left")
    runs = repeats(known.filter("copy IS NULL").select("doc", "text_hash", "text")).groupBy("doc", "text_hash").agg(F.collect_list("data").alias("runs"))
    return known.join(runs, ["doc", "text_hash"], "left")


def _gone(data: bytes, copy: bool | None, runs: list[bytes] | None) -> np.ndarray | None:
    """Which words of a text go; None if none does."""
    n = len(data.split())
    return np.ones(n, bool) if copy and n >= LENGTH else _removed(runs, n) if runs else None


def _kept_words(text: bytes, gone: np.ndarray | None) -> bytes:
    words = text.split()
    return b" ".join(words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x])


def _kept_text(text: bytes, gone: np.ndarray | None) -> bytes:
    """The text without the words that go and the white space after them; a text that loses none stays as it is."""
    if gone is None or not gone.any():
        return text
    begin = [m.start() for m in WORD.finditer(text)] + [len(text)]
    parts = [text[: begin[0]]] + [text[begin[i] : begin[i + 1]] for i in np.flatnonzero(~gone).tolist()]
    return b"".join(parts).strip(b"\x20\t\n\x0b\x0c\r")


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by single spaces.

    A word goes if a window of `LENGTH` consecutive words covers it whose word sequence also starts earlier: in a document
    with a smaller doc_id, or further left in its own. Windows are judged on the input. Null texts have no words; null ids come
    first, as one id. Rows with one id are ordered by a hash of their texts; rows equal in both are one document, and
    each of them keeps what it keeps. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                n, removed, sha = [], [], []
                for whole, copy, runs in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    data = whole.as_py().encode()
                    n.append(len(data.split()))
                    gone = _gone(data, copy, runs)
                    removed.append(0 if gone is None else int(gone.sum()))
                    sha.append(hashlib.sha256(_kept_words(data, gone)).hexdigest())
                ids = part.column(0).to_pylist()
                yield arrow_batch(schema, [[None if i == _NO_ID else i for i in ids], n, removed, sha])

    rows = _with_repeats(docs).select("doc", "text", "copy", "runs")
    return rows.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: Callable[[bytes, np.ndarray | None], bytes] = _kept_text) -> DataFrame:
    """The documents, all columns, with the words that `dedup` removes cut from their texts and n_chars counted anew.

    A text that loses no word stays as it is, a null one null; a row whose words all go keeps an empty text.
    """
    schema = docs.schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                kept = []
                for whole, copy, runs in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = whole.as_py().encode()
                    kept.append(text(data, _gone(data, copy, runs)).decode())
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), part.column(3), part.column(4)], names=["kept", "row", "no_text"])

    others = [F.lit(None).cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    rows = _with_repeats(docs, F.struct(*others).alias("row"), F.col("text").isNull().alias("no_text")).select("text", "copy", "runs", "row", "no_text")
    done = rows.mapInArrow(finish, f"kept string, row struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in schema.fields)}>, no_text boolean")
    new = {"text": F.when(~F.col("no_text"), F.col("kept")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("no_text"), F.col("row.n_chars")).otherwise(F.length("kept")).cast(schema["n_chars"].dataType).alias("n_chars")
    return done.select(*[new.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])

