"""Repair of the structure of conversations over an automaton of role and fault signatures that shares suffixes.

A conversation's signature has a symbol a row: its role's initial and whether the row is cut off, or that it must go. Read
from the end, signatures share what they end in: a node of the automaton is a different suffix, its one arc the symbol before
it. The cheapest edits of a suffix depend on the suffix and on the state of the grammar `(s?(ua)+)?` before it alone, so cost
and first edit are computed once for each node and state, for all conversations that end so. In any one state an edit leads to
one node and state; of equally cheap edits the least letter therefore begins the least audit, and the edits along the arcs are
the best audit of every suffix.

Signatures are sorted from their ends: conversations that share a suffix stand side by side, a task walks the automaton of
its range holding one path of it, and frequent signatures are dealt to several tasks by conversation.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlattice.llm.common import arrow_batch, partitions, slices, stored

#: Costs of edits by letter, and of a row that stays cut off.
COSTS, CUT_OFF = {"K": 0, "R": 3, "D": 4, "I": 3}, 3
#: Symbol of a row that must be deleted; the others are s, u, a and o (any other role), upper case if cut off.
GONE = "x"
ROLES = "suao"
#: Faults of a row by number.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States of the grammar: nothing yet, after s, after u, after a; the state after a role in each, if that may stand there.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that is inserted, or given, in each state, and its name.
MADE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
_FAR = 1 << 40

#: Best edit of each state at a node: 256 times the cost to the end, plus the letter; 0 where nothing is left to do.
Node = tuple[int, int, int, int]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) after damage by the checksum of conversation and turn; null texts and roles are a space."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("_kind")
    return rows.withColumn("_kind", F.crc32(name.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _order() -> list[Column]:
    """Order of a conversation's rows: by turn, nulls first; of one turn by role and digest of the text, equal rows side by side."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _light(rows: DataFrame) -> DataFrame:
    """Each row without its text, in order, a conversation in one task: conv_id, turn, role (its number in ROLES), fault, dropped."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.left("role", F.lit(1))
    number = F.coalesce(*[F.when(initial == r, i) for i, r in enumerate(ROLES[:3])], F.lit(3))
    shape = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    light = _with_digest(rows).select("conv_id", "turn", "role", "digest", "dropped", shape.alias("shape"), number.alias("number"))
    dealt = light.repartition(partitions(rows.sparkSession), "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when((F.col("shape") != BLANK) & (F.col("seen") > 1), DUPLICATE).otherwise(F.col("shape"))
    return dealt.withColumn("seen", seen).withColumn("fault", fault).sortWithinPartitions("conv_id", *_order(), "seen").select("conv_id", "turn", F.col("number").alias("role"), "fault", "dropped")


class _Open:
    """What is known of a conversation while its rows pass: a byte a row and some counts."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.faults = np.zeros(4, np.int64)
        self.illegal = self.turns = 0
        self.last = -1
        self.least: int | None = None
        self.most: int | None = None

    def add(self, turns: np.ndarray, timed: np.ndarray, roles: np.ndarray, faults: np.ndarray) -> None:
        if not len(roles):
            return
        self.faults += np.bincount(faults, minlength=4)
        self.symbols += _SYMBOLS[faults, roles].tobytes()
        before = np.concatenate([[self.last], roles[:-1]])
        self.illegal += int((~_LEGAL[before, roles]).sum())
        self.last = int(roles[-1])
        turns = turns[timed]
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + (self.most is None or int(turns[0]) != self.most)
            self.least = int(turns[0]) if self.least is None else self.least
            self.most = int(turns[-1])

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return gaps, int(self.faults[BLANK]), int(self.faults[DUPLICATE]), int(self.faults[TRUNCATED]), self.illegal, self.symbols[::-1].decode()


_SYMBOLS = np.array([list(ROLES.encode()), [ord(GONE)] * 4, [ord(GONE)] * 4, list(ROLES.upper().encode())], np.uint8)
#: Pairs of role numbers that may stand side by side; the last line is for the start.
_LEGAL = np.array([[False, True, False, False], [False, False, True, False], [False, True, False, False], [False] * 4, [True] * 4])


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int | None, pa.RecordBatch, bool]]:
    """Slices of equal keys of rows in order, and whether each begins a new key; a key may go on in the next slice."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        valid = batch.column(key).is_valid().to_numpy(zero_copy_only=False)
        keys = batch.column(key).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            this = int(keys[a]), bool(valid[a])
            yield this[0] if this[1] else None, batch.slice(a, b - a), this != last
            last = this


_SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, from_end string"


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, and its signature read from the end.

    `rows` as of `damaged`. Rows pass in order; of a conversation a byte a row is held.
    """
    schema = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal")], ("from_end", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, conversation = None, None
        for this, part, new in _runs(batches, 0):
            if new:
                if conversation is not None:
                    done.append((key, *conversation.row()))
                    if len(done) == 1024:
                        yield arrow_batch(schema, list(map(list, zip(*done))))
                        done = []
                key, conversation = this, _Open()
            kept = ~part.column(4).to_numpy(zero_copy_only=False)
            conversation.add(
                part.column(1).fill_null(0).to_numpy(zero_copy_only=False)[kept], part.column(1).is_valid().to_numpy(zero_copy_only=False)[kept],
                part.column(2).to_numpy(zero_copy_only=False)[kept], part.column(3).to_numpy(zero_copy_only=False)[kept],
            )
        if conversation is not None:
            done.append((key, *conversation.row()))
        if done:
            yield arrow_batch(schema, list(map(list, zip(*done))))

    return _light(rows).mapInArrow(run, _SIGNED)


def _inserted(step: list[int]) -> Node:
    """The best of each state, given the best that begins with an edit of the row itself: inserting comes before it, once or twice."""

    def insert(best: int) -> int:
        return (best // 256 + COSTS["I"]) * 256 + ord("I")

    after_u, after_a = min(step[2], insert(step[3])), min(step[3], insert(step[2]))
    return min(step[0], insert(after_u)), min(step[1], insert(after_u)), after_u, after_a


END: Node = _inserted([0 if state in ACCEPTING else _FAR * 256 for state in range(4)])


def node_before(symbol: str, rest: Node) -> Node:
    """The node of a suffix, given the one of the suffix without its first symbol."""
    step = []
    for state in range(4):
        ways = [(rest[state] // 256 + COSTS["D"]) * 256 + ord("D")]
        if symbol != GONE:
            cut = CUT_OFF if symbol.isupper() else 0
            kept, given = NEXT[state].get(symbol.lower()), NEXT[state][MADE[state]]
            if kept is not None:
                ways.append((rest[kept] // 256 + cut) * 256 + ord("K"))
            ways.append((rest[given] // 256 + COSTS["R"] + cut) * 256 + ord("R"))
        step.append(min(ways))
    return _inserted(step)


def audit_of(path: list[Node], from_end: str) -> str:
    """The edits from the first symbol on: `path[n]` is the node of the last n symbols."""
    out, state, left = [], 0, len(from_end)
    while left or path[0][state]:
        edit = chr(path[left][state] % 256)
        out.append(edit)
        if edit == "K":
            state = NEXT[state][from_end[left - 1].lower()]
        elif edit != "D":
            state = NEXT[state][MADE[state]]
        if edit != "I":
            left -= 1
    return "".join(out)


def solved(signed: DataFrame) -> DataFrame:
    """Signatures with cost and audit: nodes are shared by all conversations of a range, which share suffixes."""
    n = partitions(signed.sparkSession)
    columns = [c.split()[0] for c in _SIGNED.split(", ")]
    schema = pa.schema([(c, pa.int64()) for c in columns[:-1]] + [("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, before, audit = [END], "", ""
        for batch in batches:
            costs, audits = [], []
            for from_end in batch.column(len(columns) - 1).to_pylist():
                if from_end != before or not audits:
                    del path[len(os.path.commonprefix((before, from_end))) + 1 :]
                    for symbol in from_end[len(path) - 1 :]:
                        path.append(node_before(symbol, path[-1]))
                    before, audit = from_end, audit_of(path, from_end)
                costs.append(path[-1][0] // 256)
                audits.append(audit)
            yield arrow_batch(schema, [*batch.columns[:-1], costs, audits])

    ranged = signed.repartitionByRange(n, "from_end", "conv_id").sortWithinPartitions("from_end")
    return ranged.select(*columns).mapInArrow(run, _SIGNED.replace("from_end string", "cost long, audit string"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _together(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's counts and audit, then its rows in order, in one task."""
    kept = _with_digest(rows.filter(~F.col("dropped"))).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    both = found.select("conv_id", F.lit(0).alias("kind"), F.col("audit").alias("text"), *_COUNTS).unionByName(kept, allowMissingColumns=True)
    dealt = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return dealt.select("conv_id", "kind", "role", "text", *_COUNTS)


class _Edits:
    """Goes through an audit as the rows come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> str:
        name = NAMES[MADE[self.state]]
        self.state = NEXT[self.state][MADE[self.state]]
        return name

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Rows (edit, role, text) to be inserted here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._made(), ""

    def of(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._made(), text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, tuple | None, Iterator[tuple[str, str, str]]]]:
    """(conv_id, counts and audit where it begins, rows as repaired); the last rows of a conversation come with the next one's start."""
    edits = None
    key = None
    for this, whole, new in _runs(batches, 0):
        for part in slices(whole, 3):
            for kind, role, text, *counts in zip(*[c.to_pylist() for c in part.columns[1:]]):
                if kind == 0:
                    if edits is not None:
                        yield key, None, edits.inserted()
                    key, edits = this, _Edits(text)
                    yield key, (*counts, text), iter(())
                else:
                    yield key, None, edits.of(role, text)
    if edits is not None:
        yield key, None, edits.inserted()


def repaired(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The rows of repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text.

    `rows` takes another form of them, such as `damaged` gives. Null roles and texts are a space, a null conv_id is a conversation
    of its own, null turns come first; rows of one turn stand by role and digest of their text, and repeated rows are duplicates. Blank rows go, so
    empty texts leave inserted ones alone. Roles count by their first letter; one without is kept nowhere. Other columns are not
    read. An empty table gives no rows. A conversation's rows pass one task in order, its texts one at a time.
    """
    rows = undamaged(conversations) if rows is None else rows
    found = solved(stored(signatures(rows), "conversations-signed"))
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        place = size = 0
        for key, start, made in _edited(batches):
            place = 0 if start is not None else place
            for edit, role, text in made:
                out.append((key, place, edit, role, text))
                place, size = place + 1, size + len(text)
                if len(out) == 1024 or size > 1 << 20:
                    yield arrow_batch(schema, list(map(list, zip(*out))))
                    out, size = [], 0
        if out:
            yield arrow_batch(schema, list(map(list, zip(*out))))

    return _together(rows, found).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(conversations: DataFrame) -> DataFrame:
    """Per conv_id of the table, after damage: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    As `repaired`, with the digest taken as the rows come by: SHA-256 reads a conversation in order, so this is one task's work, holding
    one text. Conversations of which damage leaves nothing have zeros, an empty audit and the digest of nothing.
    """
    rows = damaged(conversations)
    found = solved(stored(signatures(rows), "conversations-signed"))
    schema = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        counts, first, h = None, True, hashlib.sha256()
        for key, start, made in _edited(batches):
            if start is not None:
                if counts is not None:
                    out.append((*counts, h.hexdigest()))
                    if len(out) == 1024:
                        yield arrow_batch(schema, list(map(list, zip(*out))))
                        out = []
                counts, first, h = (key, *start), True, hashlib.sha256()
            for _, role, text in made:
                h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if counts is not None:
            out.append((*counts, h.hexdigest()))
        if out:
            yield arrow_batch(schema, list(map(list, zip(*out))))

    columns = ", ".join(f"{k} long" for k in _COUNTS)
    return _together(rows, found).mapInArrow(run, f"conv_id long, {columns}, audit string, repaired_sha256 string")
