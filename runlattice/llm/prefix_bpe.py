"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix of a byte string ends in one definite token. A token t ends the prefix p + t if the last
token of p and t, written side by side, merge back into just these two tokens. So one pass over the bytes that tries the
tokens ending at each byte, longest first, finds the last token of every prefix; the encoding is read backwards from the
end. Appending continues the pass and never changes what stands. An edit redoes the pass from its place on until the last
tokens are again those of the old text for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from runlattice.llm.common import Remembered, arrow_batch, digest_of, loaded, slices, texts

#: Unicode white space, as character class content.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space and what follows up to the next one. No match of the split patterns reaches over such a border:
#: a match holds white space at its start or throughout, and the character before the border isn't white.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Texts with longer runs of white space, or two at their end, are cut by CHUNK; before every space and line feed the others.
LONG_RUN = re.compile(f"[{WHITE}]{{3}}|[{WHITE}]{{2}}$|\0")
#: Chunks that a worker remembers; forgetting costs time and changes nothing.
CHUNKS = 600_000
#: Results of tests that a worker remembers for each token.
TESTED = 100_000
NEVER = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBpe:
    """Encoder of single pieces. `last[i]` is the last token of the first i bytes; `last[0]` is -1, for the start."""

    def __init__(self, ranks: dict[bytes, int]):
        lacking = [i for i in range(256) if bytes([i]) not in ranks]
        if lacking:
            raise ValueError(f"{len(lacking)} single bytes have no rank")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._edges: dict[int, list[tuple[bytes, int]]] = {}
        self._ends = ahocorasick.Automaton()
        for t, i in ranks.items():
            # Length, token, and which tokens it may follow (-1: the start), as far as tested.
            self._ends.add_word(t.decode("latin-1"), (len(t), i, {}))
        self._ends.make_automaton()

    def merged(self, piece: bytes, down_to: int = 1) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none merge or few are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one edge of the token while it is merged, oldest first, with the rank that makes it; empty if
        merging the token's bytes doesn't give the token."""
        key = 2 * token + right
        if key not in self._edges:
            piece = self.bytes_of[token]
            if len(piece) == 1:
                own = [(piece, -1)]
            else:
                halves = self.merged(piece, 2)
                inner = self._edge(halves[-1 if right else 0], right) if len(halves) == 2 else []
                own = [*inner, (piece, token)] if inner else []
            self._edges[key] = own
        return self._edges[key]

    def _follows(self, left: int, right: int) -> bool:
        """Whether right may stand after left: merged side by side, no merge reaches over the border between them.

        Merges go by rank, so the two edges grow in that order; the border breaks if what stands at it has a lower rank
        together than the next growth on the left has, and none higher than that on the right (leftmost goes first).
        """
        after = self._edge(right, False)
        if left < 0 or not after:
            return bool(after)
        before, ranks = self._edge(left, True), self.ranks
        i = j = 0
        while before:
            across = ranks.get(before[i][0] + after[j][0], NEVER)
            grow_left = before[i + 1][1] if i + 1 < len(before) else NEVER
            grow_right = after[j + 1][1] if j + 1 < len(after) else NEVER
            if across < NEVER and across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == NEVER:
                return True
            i, j = (i + 1, j) if grow_left <= grow_right else (i, j + 1)
        return False

    def _test(self, left: int, right: int, after: dict[int, bool]) -> bool:
        if len(after) >= TESTED:
            after.clear()
        after[left] = ok = self._follows(left, right)
        return ok

    def extend(self, piece: bytes, last: list[int] | None = None, stop: int | None = None) -> list[int]:
        """Last tokens of all prefixes, or of those of up to `stop` bytes; `last`: those of the first bytes, if known.

        Of the tokens that end at a byte, longest first, the first counts that follows the last token before it.
        """
        last = [-1] if last is None else list(last)
        known = len(last)
        for at, (n, token, after) in self._ends.iter(piece[:stop].decode("latin-1"), max(0, known - self.longest)):
            if at + 1 == known:
                left = last[known - n]
                ok = after.get(left)
                if ok or ok is None and self._test(left, token, after):
                    last.append(token)
                    known += 1
        return last

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes start to stop replaced, and its last tokens, redone only near the edit."""
        out = piece[:start] + new + piece[stop:]
        shift, same = len(new) - (stop - start), 0
        fresh = self.extend(out, last[: start + 1], start + len(new))
        while len(fresh) <= len(out):
            end = len(fresh)
            fresh = self.extend(out, fresh, end)
            same = same + 1 if fresh[end] == last[end - shift] else 0
            if same >= self.longest:
                return out, fresh + last[end - shift + 1 :]
        return out, fresh

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding, read backwards from the end."""
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, merges or not."""
        token = self.ranks.get(piece)
        return [token] if token is not None else self.tokens(self.extend(piece))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def chunks_of(text: str) -> list[str]:
    """The text cut where no match of the split pattern can reach over."""
    if LONG_RUN.search(text):
        return CHUNK.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


class TextEncoder:
    """Whole texts: split by the pattern, every match encoded by itself, chunks between white space remembered."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        self.bpe, self._split = bpe, regex.compile(pattern)
        self._known = Remembered(self._chunks, CHUNKS)

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        split = self._split.findall
        matches = [split(c) for c in chunks]
        ids, bpe, before, last = {}, self.bpe, b"", [-1]
        for match in sorted({m for found in matches for m in found}):
            piece = match.encode()
            token = bpe.ranks.get(piece)
            if token is None:  # a piece goes on from the bytes it shares with the one before it
                last = bpe.extend(piece, last[: len(os.path.commonprefix((before, piece))) + 1])
                before = piece
            ids[match] = np.array([token] if token is not None else bpe.tokens(last), "<u4").tobytes()
        return (b"".join(map(ids.__getitem__, found)) for found in matches)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, unsigned 32-bit."""
        return [np.frombuffer(x, "<u4") for x in self._known.joined([chunks_of(t) for t in texts])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def encoder_of(ranks: bytes, pattern: str) -> TextEncoder:
    return loaded(digest_of(b"bpe", ranks, pattern.encode()), lambda: TextEncoder(PrefixBpe(read_ranks(ranks)), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row (doc_id, ids, decoded) per row of documents: token ids of the whole text, and the bytes they decode to.

    A map: rows keep their place, nothing is shuffled. Empty and null texts have no ids and decode to nothing. Repeated
    rows and ids stay as they are, a null doc_id stays null, other columns are not read. An empty table gives none.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder_of(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = tool.encode_all(part.column(1).to_pylist())
                yield arrow_batch(schema, [part.column(0), [x.astype(np.int32) for x in ids], [tool.bpe.decode(x.tolist()) for x in ids]])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256. As `encode`, with digests
    taken where the ids are, so that ids need not leave the worker."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder_of(ranks.value, pattern)
        named = loaded("decimal" + str(max(tool.bpe.bytes_of)), lambda: list(map(str, range(max(tool.bpe.bytes_of) + 1))))
        for batch in batches:
            for part in slices(batch, 1):
                counts, ids_sha, decoded_sha = [], [], []
                for ids in map(np.ndarray.tolist, tool.encode_all(part.column(1).to_pylist())):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(named.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(tool.bpe.decode(ids)).hexdigest())
                yield arrow_batch(schema, [part.column(0), counts, ids_sha, decoded_sha])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
