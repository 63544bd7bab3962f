"""WARC archives: records in compressed files, an index of byte ranges written first, reads by range.

Writing deals the pages out, and each task writes files of records, a gzip member each, and a row per record to the index: file,
offset, length, URL, digest, type. The index is a table that Spark commits, so records of lost attempts are in no index. Reading
selects rows of the index, sorts them by file and offset, joins ranges that lie close together, and fetches each such
range once.

Of pages with equal payloads the one with the largest page_id is stored as response; the others are revisits that name it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import arrow_batch, new_name, partitions, slices, store_of
from runlattice.session import shared_folder

#: Bytes of a file after which a task begins another.
FILE_BYTES = 512 << 20
#: Ranges less than GAP bytes apart are read together, up to SPAN bytes; a task reads parts of a file of PART bytes.
GAP, SPAN, PART = 64 << 10, 8 << 20, 32 << 20
#: Fixed value: the date of all records, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
_INDEX = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]
    + [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _header_value(text: str) -> str:
    """As in a header line: control characters and spaces percent-encoded."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header, which tells the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP message, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record does not end where it should")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return int(page) if page else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _File:
    def __init__(self, folder: str):
        store, path = store_of(folder)
        self.name, self.size = new_name("pages", ".warc.gz"), 0
        self._out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        info = b"software: page archive\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.add(head.encode() + info + b"\r\n\r\n")

    def add(self, data: bytes) -> tuple[int, int]:
        packed = gzip.compress(data, 3, mtime=0)
        at = self.size
        self._out.write(packed)
        self.size += len(packed)
        return at, len(packed)

    def close(self) -> None:
        self._out.close()


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of all pages in the folder; returns the index of their records.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response, the others are
    revisits of it; smaller ones are all responses. A null html is an empty payload, a null url an empty address. Rows that
    repeat the page_id and payload of a response are responses; a null page_id is the least. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    small = rows.select("page_id", "sha1")
    if least > 0:
        small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).alias("n")).filter(F.col("n") >= least).drop("n")
    key = F.coalesce("page_id", F.lit(-(1 << 63))).alias("key")
    # Equal payloads meet as digests alone, combined before the shuffle; pages then meet their decision by page_id, which is even.
    last = small.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = small.join(last, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(key, "sha1", "refers_to").distinct()
    decided = rows.select("*", key).join(revisits.withColumn("revisit", F.lit(True)), ["key", "sha1"], "left")
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _File | None = None
        for batch in batches:
            for part in slices(batch, 2, 1 << 20, 256):
                made = []
                for page_id, url, text, refers_to, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    if out is not None and out.size >= FILE_BYTES:
                        out.close()
                        out = None
                    out = out or _File(folder)
                    payload = text.encode()
                    digest = base32_sha1(payload)
                    at, n = out.add(record(page_id, url, payload, digest, refers_to, bool(revisit)))
                    made.append((page_id, url, digest, "revisit" if revisit else "response", out.name, at, n))
                if made:
                    yield arrow_batch(_INDEX, list(zip(*made)))
        if out is not None:
            out.close()

    decided.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Runs of ascending records that are fetched at once: first, last + 1, start, end in bytes."""
    first = 0
    for i in range(1, len(offsets) + 1):
        end = offsets[i - 1] + lengths[i - 1]
        if i == len(offsets) or offsets[i] - end > GAP or offsets[i] + lengths[i] - offsets[first] > SPAN:
            yield first, i, offsets[first], end
            first = i


def read(selected: DataFrame, folder: str, content: bool = True) -> DataFrame:
    """The selected records of the index, read by range: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and
    payload (null for revisits) if `content`. What is returned comes from the records; a response's digest is computed
    anew and must be the one it states."""
    spark = selected.sparkSession
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * content)
    rows = (
        selected.select("file", "offset", "length", "url")
        .repartition(partitions(spark), "file", F.floor(F.col("offset") / PART))
        .sortWithinPartitions("file", "offset")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        name, source = None, None
        for batch in batches:
            files = batch.column(0).to_pylist()
            cuts = [0, *(np.flatnonzero(np.array(files[1:], object) != np.array(files[:-1], object)) + 1).tolist(), len(files)] if files else [0]
            for a, b in zip(cuts, cuts[1:]):
                if files[a] != name:
                    if source:
                        source.close()
                    name, source = files[a], store.open_input_file(f"{path}/{files[a]}")
                offsets, lengths, urls = (batch.column(i)[a:b].to_pylist() for i in (1, 2, 3))
                for first, last, start, end in ranges(offsets, lengths):
                    source.seek(start)
                    data = source.read(end - start)
                    found = []
                    for i in range(first, last):
                        at = offsets[i] - start
                        headers, http, payload = parsed(gzip.decompress(data[at : at + lengths[i]]))
                        kind, digest, n = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"a payload in {name} is not what its record states")
                        refers_to = _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        row = (_page_of(headers["WARC-Record-ID"]), urls[i], n, digest, kind, refers_to)
                        found.append(row + ((payload if kind == "response" else None),) * content)
                    yield arrow_batch(schema, list(zip(*found)))
        if source:
            source.close()

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return rows.mapInArrow(run, kinds + ", payload binary" * content)


def round_trip(pages: DataFrame) -> DataFrame:
    """All pages written to archives in a new shared folder and read back, without the payloads themselves."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read(write(pages, folder), folder, content=False).drop("url")
