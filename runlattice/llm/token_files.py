"""Token ids in binary shards: one compressed frame a document, a shared dictionary, an index of offsets.

A shard is

    magic (8 bytes) | length of the header (u32) | header, JSON | frames | index | offset of the index (u64) | magic

with little-endian numbers. The header names the width of an id and the SHA-256 of the dictionary that the frames need;
the dictionary is a file of its own in the same folder. The index holds, per document in ascending doc_id order,
doc_id (i64), whether it is null (u8), the frame's offset (u64, one more for the end) and the number of ids (u32). So one short
document is read with three range reads: the shard's tail, its index, its frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from runlattice.llm.common import (
    Remembered,
    arrow_batch,
    digest_of,
    loaded,
    new_name,
    partitions,
    sampled,
    slices,
    splits,
    store_of,
    texts,
)
from runlattice.session import shared_folder

MAGIC = b"TOKSHRD1"
#: The dictionary is trained on the ids of this many documents, the first of each of them; every document is then written.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 8192, 65536
#: Bytes of frames after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: Parts of texts that a worker remembers.
WORDS = 800_000
#: Bytes and rows of text that are encoded together, and words whose ids are put in place at once.
ENCODED_BYTES, ENCODED_ROWS, GATHERED = 8 << 20, 4096, 1 << 20
#: Words that go through the model side by side.
TOGETHER = 256


class WordEncoder:
    """A tokenizer whose normaliser and splitter treat the texts between spaces and line feeds alone, with a table of them.

    Words that are letters of the first 256 code points alone need neither: they are composed already, lower case by
    character, and one word to the model. All others go through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        self._whole = Tokenizer.from_str(tokenizer)
        self._plain = _lower_and_split(json.loads(tokenizer))
        self._known = Remembered(self._compute, WORDS)
        #: Byte-level alphabet beyond ASCII: bytes that print stand for themselves, the others for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self._letters = {b: chr(256 + i) for i, b in enumerate(hidden) if b > 127}
        #: The model alone, on words between spaces, and the bytes of each of its tokens.
        self._words = Tokenizer(self._whole.model)
        self._words.pre_tokenizer = WhitespaceSplit()
        vocabulary = self._whole.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        suffix = json.loads(tokenizer)["model"].get("end_of_word_suffix") or ""
        self._bytes[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]

    def _lettered(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)

    def _plain_words(self, words: list[str]) -> Iterator[bytes]:
        """Of words of letters, a full stop or comma at their end or none. They go through the model side by side; where a
        word ends among the tokens shows in the bytes that these stand for."""
        texts = [
            self._lettered(" ".join([f"{w[:-1]} {w[-1]}" if w.endswith((".", ",")) else w for w in words[i : i + TOGETHER]]).lower())
            for i in range(0, len(words), TOGETHER)
        ]
        ids = np.concatenate([np.array(got.ids, "<u4") for got in self._words.encode_batch_fast(texts, add_special_tokens=False)])
        size = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        ends = np.cumsum(self._bytes[ids])
        if ends[-1] != size.sum():
            raise ValueError("the model's tokens don't add up to the words")
        data, stops = ids.tobytes(), (4 * np.searchsorted(ends, np.cumsum(size), "right")).tolist()
        return (data[a:b] for a, b in zip([0, *stops], stops))

    def _compute(self, words: list[str]) -> Iterator[bytes]:
        found: dict[str, bytes] = {"": b""}
        plain: tuple[list[str], list[str]] = [], []  # of ASCII alone, and others
        if self._plain:
            for word in words:
                stem = word[:-1] if word.endswith((".", ",")) else word
                if stem.isalpha() and (stem.isascii() or max(stem) < "Ā"):
                    plain[not stem.isascii()].append(word)
        for some in filter(None, plain):
            found.update(zip(some, self._plain_words(some)))
        rest = [w for w in words if w not in found]
        for word, got in zip(rest, self._whole.encode_batch_fast(rest, add_special_tokens=False)):
            found[word] = struct.pack(f"<{len(got.ids)}I", *got.ids)
        return map(found.__getitem__, words)

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [x.tobytes() for x in self.arrays(pa.array(batch, pa.string()))]

    def arrays(self, batch: pa.Array, width: int = 4, end_id: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text, unsigned and little-endian, with the end id if one is given. Words that a batch repeats are looked
        up once; those of ASCII letters in lower case, where the tokenizer has them so."""
        lists = pc.split_pattern(pc.replace_substring(batch, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        if self._plain:
            folded = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words).dictionary_encode()
            words, which = folded.dictionary, folded.indices.to_numpy()[which]
        known = self._known.each(words.to_pylist())
        flat = np.frombuffer(b"".join(known), "<u4").astype(f"<u{width}")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        end = np.array([] if end_id is None else [end_id], flat.dtype)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            parts = [_gathered(flat, starts, sizes, which[at : min(at + GATHERED, b)]) for at in range(a, b, GATHERED)]
            yield np.concatenate([*parts, end])


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of `flat` with these numbers, end to end."""
    n = sizes[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _lower_and_split(spec: dict) -> bool:
    """Whether the file asks for NFC, white space dropped, lower case, runs of letters apart and byte-level words."""
    steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
    pattern = split[0].get("pattern", {}).get("Regex", "")
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [s.get("type") for s in split] == ["Split", "ByteLevel"]
        and r"[\p{L}]+" in pattern
        and not split[1].get("add_prefix_space")
    )


def _space_bound(spec: dict) -> None:
    """The table of words is right only if no id depends on what stands beyond a space."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    if split[0].get("type") != "Split" or not split[0].get("invert") or r"[^\s" not in split[0].get("pattern", {}).get("Regex", ""):
        raise ValueError("a tokenizer that drops white space is needed")


def _encoder(spec: str) -> WordEncoder:
    return loaded(digest_of(b"words", spec.encode()), lambda: WordEncoder(spec))


def _width(spec: dict) -> int:
    return 2 if len(spec["model"]["vocab"]) <= 1 << 16 else 4


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; where they are too few to train, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Encodes every whole text, appends the end id, writes shards in ascending doc_id order; returns their index.

    The index has a row per shard: position in doc_id order (bucket, part), file, n_docs, n_tokens, bytes. It is written by
    Spark, so only shards of tasks that ended well are in it; files of lost attempts are never read.

    Null and empty texts are the end id alone. Null ids come first; rows with one id stand side by side, ordered by their
    frames; other columns are not read. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    _space_bound(json.loads(text))
    width = _width(json.loads(text))
    spec = spark.sparkContext.broadcast(text)
    rows = texts(docs)
    ids_of = partial(_ids, spec, end_id, width)

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_pydict({"row": part.column(0), "ids": [x[:SAMPLE_BYTES] for _, x in ids_of(part)]})

    taken = sampled(rows, "doc_id", "text", SAMPLE_DOCS).select("row", "value").mapInArrow(begins, "row long, ids binary")
    words = _dictionary([bytes(r.ids) for r in sorted(taken.collect(), key=lambda r: r.row)])
    name = hashlib.sha256(words).hexdigest()
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}.dictionary") as out:
        out.write(words)

    n = partitions(spark)
    cuts = np.array(splits(rows, "doc_id", n), np.int64)
    shared = spark.sparkContext.broadcast(words)
    encoded = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, dict_data=_zstd_dictionary(shared.value), write_content_size=True)
        for batch in batches:
            for part in slices(batch, 1, ENCODED_BYTES, ENCODED_ROWS):
                got = [(n, pack.compress(x)) for n, x in ids_of(part)]
                ids = part.column(0)
                bucket = np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
                yield arrow_batch(encoded, [bucket, ids, [n for n, _ in got], [x for _, x in got]])

    index = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])
    header = {"id_bytes": width, "dictionary_sha256": name}

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        shard, number = None, 0
        for batch in batches:
            for bucket, doc_id, n_tokens, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is not None and (shard.bucket != bucket or shard.size >= SHARD_BYTES):
                    number = number + 1 if shard.bucket == bucket else 0
                    yield arrow_batch(index, [[x] for x in shard.close()])
                    shard = None
                if shard is None:
                    shard = _Shard(store, path, bucket, number, header)
                shard.add(doc_id, n_tokens, frame)
        if shard is not None:
            yield arrow_batch(index, [[x] for x in shard.close()])

    ordered = (
        rows.mapInArrow(compress, "bucket int, doc_id long, n_tokens long, frame binary")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "frame")
    )
    ordered.mapInArrow(shards, "bucket int, part int, file string, n_docs long, n_tokens long, bytes long").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _ids(spec, end_id: int, width: int, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of the ids of each row, the end id included."""
    for got in _encoder(spec.value).arrays(batch.column(1), width, end_id):
        yield len(got), got.tobytes()


def _zstd_dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


class _Shard:
    def __init__(self, store, path: str, bucket: int, number: int, header: dict):
        self.bucket, self.number, self.size, self.n_tokens = bucket, number, 0, 0
        self.file = new_name(f"{bucket:06d}-{number:04d}", ".tokens")
        self._out = store.open_output_stream(f"{path}/{self.file}")
        self._ids: list[int | None] = []
        self._counts: list[int] = []
        own = json.dumps(header).encode()
        self._offsets = [self._write(MAGIC + struct.pack("<I", len(own)) + own)]

    def _write(self, data: bytes) -> int:
        self._out.write(data)
        self.size += len(data)
        return self.size

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self._ids.append(doc_id)
        self._counts.append(n_tokens)
        self.n_tokens += n_tokens
        self._offsets.append(self._write(frame))

    def close(self) -> tuple:
        at = self.size
        known = [0 if i is None else i for i in self._ids]
        for values, kind in ((known, "<i8"), ([i is None for i in self._ids], "u1"), (self._offsets, "<u8"), (self._counts, "<u4")):
            self._write(np.array(values).astype(kind).tobytes())
        self._write(struct.pack("<Q", at) + MAGIC)
        self._out.close()
        return self.bucket, self.number, self.file, len(self._ids), self.n_tokens, self.size


class ShardReader:
    """Range reads of one shard: the index when opened, a frame for each document asked for."""

    def __init__(self, folder: str, file: str):
        self._store, self._path = store_of(folder)
        self._in = self._store.open_input_file(f"{self._path}/{file}")
        size = self._in.size()
        at, end = struct.unpack("<Q8s", self._range(size - 16, 16))
        if end != MAGIC or self._range(0, 8) != MAGIC:
            raise ValueError(f"{file} is no token shard")
        self.header = json.loads(self._range(12, struct.unpack("<I", self._range(8, 4))[0]))
        index = self._range(at, size - 16 - at)
        n = (len(index) - 8) // 21
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u4", n, 17 * n + 8)
        self._unpack = None

    def _range(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def _decompressor(self):
        if self._unpack is None:
            name = self.header["dictionary_sha256"]
            with self._store.open_input_file(f"{self._path}/{name}.dictionary") as f:
                words = f.read()
            if hashlib.sha256(words).hexdigest() != name:
                raise ValueError(f"dictionary {name} is not the one that the shard names")
            self._unpack = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(words))
        return self._unpack

    def document(self, row: int) -> np.ndarray:
        """Ids of the row-th document of the shard."""
        at, end = int(self.offsets[row]), int(self.offsets[row + 1])
        return self._ids(self._range(at, end - at), row)

    def _ids(self, frame: bytes, row: int) -> np.ndarray:
        ids = np.frombuffer(self._decompressor().decompress(frame), f"<u{self.header['id_bytes']}").astype("<u4")
        if len(ids) != self.counts[row]:
            raise ValueError("a frame does not hold the ids that the index counts")
        return ids

    def documents(self, step: int = 8 << 20) -> Iterator[np.ndarray]:
        """Ids of all documents in order, read in large ranges."""
        row, n = 0, len(self.doc_ids)
        while row < n:
            start = int(self.offsets[row])
            stop = max(int(np.searchsorted(self.offsets, start + step, "right")) - 1, row + 1)
            data = self._range(start, int(self.offsets[stop]) - start)
            for r in range(row, stop):
                yield self._ids(data[int(self.offsets[r]) - start : int(self.offsets[r + 1]) - start], r)
            row = stop

    def close(self) -> None:
        self._in.close()


def read(index: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and its ids or their crc32."""
    n = partitions(index.sparkSession)
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = index.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")).repartition(n, "file")
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(folder, file)
                counts = shard.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls.astype(bool))
                out: list = []
                at = 0
                for got in shard.documents():
                    out.append(zlib.crc32(got.tobytes()) if digest else got.astype(np.int64))
                    if len(out) == 256 or at + len(out) == len(counts):
                        part = slice(at, at + len(out))
                        yield arrow_batch(schema, [ids[part], starts[part], counts[part], out])
                        at, out = at + len(out), []
                shard.close()

    return starts.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes shards to a new shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer_path, end_id, folder), folder, digest=True)
