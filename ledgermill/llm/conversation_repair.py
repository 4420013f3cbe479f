"""Repair of the structure of conversations: the cheapest edits that give a dialogue of alternating roles.

The messages of a conversation are taken by turn, nulls first; messages of one turn by role, then by the SHA-256
of their text. A message's first fault counts: blank, duplicate (role and text stood earlier) or truncated (its last
character that is no white space ends no sentence). Blank and duplicate messages must go; the rest is kept, changed in
its role or deleted, and messages without text are inserted, so that the initials of the roles are those of an
optional system message and of questions with answers. ``earley`` finds the cheapest edits, of several the least audit.

A conversation is read by one task, in order. One of more than LONG_ROWS messages or LONG_CHARS characters is
not held in memory: its messages are dealt to tasks by ranges of turns, each task parses its range from every state
in which it can begin, and the ranges are joined by their least (cost, audit). Only the digest of a repaired text is
made in one pass over it, since SHA-256 has no other way; the pass holds one message at a time.

Defined results: nulls of conv_id, role and text are one space, but a null conv_id is returned as null and a null turn
stands first; a role of no character fits nowhere; repeated rows are duplicates. A conversation without messages has
no faults, no edits and the digest of an empty text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.earley import DELETE, INSERT, KEEP, Best, Repair, matrix, token
from ledgermill.llm.shared import partitions_of, stage

#: Beyond so many messages or characters a conversation is parsed by several tasks.
LONG_ROWS, LONG_CHARS = 10_000, 16_000_000
#: Long conversations that are told from the others by a broadcast table; more of them are met by a shuffle.
FEW_LONG = 100_000
_SPACES = " \t\n\x0b\x0c\r"
_FAULTS = ("blank", "duplicate", "truncated")
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGES = "place long, role string, text string, edit string"


def _as_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as a transfer spoils them, by a hash of conversation and turn; ``copies`` is 0 for a lost message and 2 for a repeated one."""
    kind = F.crc32(F.concat(_as_text("conv_id"), F.lit(":"), _as_text("turn")).cast("binary")) % 20
    role, text = _as_text("role"), _as_text("text")
    spoiled = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), spoiled.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def as_messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1) of undamaged rows."""
    return rows.select("conv_id", "turn", _as_text("role").alias("role"), _as_text("text").alias("text"), F.lit(1).alias("copies"))


def _described(messages: DataFrame) -> DataFrame:
    """messages with what the parser needs to know of a text; lost messages leave a row without one, for their conversation."""
    there = F.col("copies") > 0
    text = F.when(there, F.col("text")).otherwise("")
    end = F.rtrim(text, F.lit(_SPACES))
    return messages.select(
        "conv_id", "turn", F.when(there, F.col("role")).otherwise("").alias("role"), text.alias("text"), F.col("copies").cast("int").alias("copies"),
        (end == "").alias("is_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("is_open"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )


_COLUMNS = ("conv_id", "turn", "role", "text", "copies", "is_blank", "is_open", "digest", "seen")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest")


class _Summary:
    """Counts of the messages of a conversation as they come, and its repaired messages by the edits of an audit."""

    def __init__(self, best: Best):
        self.cost, self.audit = best
        self.at, self.hash, self.last_role = 0, hashlib.sha256(), ""
        self.counts = dict.fromkeys((*_FAULTS, "illegal"), 0)
        self.turns, self.last_turn, self.first_turn, self.initial, self.n_out = 0, None, None, None, 0

    def message(self, turn: int | None, role: str, text: str, fault: str) -> Iterator[dict]:
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns, self.last_turn = self.turns + 1, turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != DELETE:
            yield self._put(role if edit == KEEP else self._following(), text, edit)

    def end(self) -> Iterator[dict]:
        yield from self._inserted()

    def _inserted(self) -> Iterator[dict]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            yield self._put(self._following(), "", INSERT)

    def _following(self) -> str:
        return "assistant" if self.last_role[:1] == "u" else "user"

    def _put(self, role: str, text: str, edit: str) -> dict:
        self.hash.update(f"{chr(10) if self.n_out else ''}{role}:{text}".encode())
        self.last_role, self.n_out = role, self.n_out + 1
        return {"place": self.n_out - 1, "role": role, "text": text, "edit": edit}

    def row(self) -> dict:
        gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.counts | {"gaps": gaps, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def _faults(copies: int, is_blank: bool, is_open: bool, seen: bool) -> list[str]:
    """The fault of each copy of a message."""
    if is_blank:
        return ["blank"] * copies
    return ["duplicate" if seen or copy else "truncated" if is_open else "" for copy in range(copies)]


def _short(rows: Iterable[tuple]) -> tuple[Best, list[tuple]]:
    """The repair of a conversation in memory, and its messages with faults."""
    messages, stood = [], set()
    for _, turn, role, text, copies, is_blank, is_open, digest, _ in rows:
        messages += [(turn, role, text, fault) for fault in _faults(copies, is_blank, is_open, (role, digest) in stood)]
        if copies:
            stood.add((role, digest))
    repair = Repair()
    repair.read("".join(token(role[:1], fault) for _, role, _, fault in messages))
    return repair.result(), messages


def _long(rows: Iterator[tuple]) -> tuple[Best, Iterator[tuple]]:
    """The repair that stands before the messages of a long conversation, and its messages as they come."""
    head = next(rows)
    found = ((turn, role, text, fault) for _, turn, role, text, copies, is_blank, is_open, _, seen, *_ in rows for fault in _faults(copies, is_blank, is_open, seen))
    return (head[-2], head[-1]), found


def _told(rows: DataFrame, of_conversation, with_messages: bool) -> DataFrame:
    """A row for each conversation, or for each of its repaired messages, of rows in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars, schema = [], 0, None

        def each() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                if schema is None:
                    text = [pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in (_MESSAGES if with_messages else _SUMMARY).split(", "))]
                    schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *text])
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for conv_id, rows in groupby(each(), key=itemgetter(0)):
            best, messages = of_conversation(rows)
            summary = _Summary(best)
            for message in (x for m in messages for x in summary.message(*m)):
                if with_messages:
                    out.append({"conv_id": conv_id, **message})
                    chars += len(message["text"])
                    if chars > LONG_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, chars = [], 0
            rest = list(summary.end())
            out += [{"conv_id": conv_id, **x} for x in (rest if with_messages else [summary.row()])]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, f"conv_id {kind}, {_MESSAGES if with_messages else _SUMMARY}")


def repair_conversations(messages: DataFrame, with_messages: bool = False, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """A row for each conv_id of messages (as of ``damage`` or ``as_messages``): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``with_messages``, the repaired messages instead: conv_id, place, role, text and edit (K, R or I).
    """
    sizes = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    long = stage(sizes.where((F.col("n_rows") > long_rows) | (F.col("n_chars") > long_chars)).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")))
    rows, n_long = _described(messages), long.count()
    if not n_long:
        return _told(_in_order(rows.withColumn("seen", F.lit(False)).select(*_COLUMNS)), _short, with_messages)
    marked = rows.join(F.broadcast(long) if n_long <= FEW_LONG else long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    short = marked.where("is_long IS NULL").withColumn("seen", F.lit(False)).select(*_COLUMNS)
    # messages of one role and text meet to tell the first of them; a lost one is no message
    same = Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first())
    pieces = stage(marked.where("is_long").withColumn("seen", F.row_number().over(same) > 1).select(*_COLUMNS))
    head = _joined(_ranges(pieces)).select("conv_id", *(F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in _COLUMNS[1:]), F.lit(0).alias("part"), "cost", "audit")
    whole = head.unionByName(pieces.withColumn("part", F.lit(1)), allowMissingColumns=True).select(*_COLUMNS, "part", "cost", "audit")
    return _told(_in_order(short), _short, with_messages).unionByName(_told(_in_order(whole, "part"), _long, with_messages))


_PIECE = "piece long, entry string, name string, cost long, audit string"


def _ranges(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, entry, name, cost and audit: what each range of a conversation's messages costs from state to state."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    first = F.when(F.col("copies") == 0, "").when(F.col("is_blank") | F.col("seen"), "-").otherwise(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x"))
    letter = F.concat(F.when(F.col("is_open"), F.upper(first)).otherwise(first), F.when(F.col("copies") == 2, "-").otherwise(""))
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    rows = pieces.select("conv_id", "turn", "role", "digest", letter.alias("letter")).repartitionByRange(partitions_of(pieces.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        each = (pair for b in batches for pair in zip(b.column(0), b.column(1).to_pylist()))
        for conv_id, found in groupby(each, key=itemgetter(0)):
            out = [{"piece": piece, "entry": e, "name": n, "cost": c, "audit": a} for (e, n), (c, a) in matrix("".join(x for _, x in found)).items()]
            columns = [pa.array([x[k] for x in out]) for k in ("piece", "entry", "name", "cost", "audit")]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id.as_py()] * len(out), conv_id.type), *columns], names=["conv_id", "piece", "entry", "name", "cost", "audit"])

    return rows.mapInArrow(run, f"conv_id {kind}, {_PIECE}")


def _joined(ranges: DataFrame) -> DataFrame:
    """conv_id, cost and audit of the whole conversations of ranges."""
    kind = ranges.schema["conv_id"].dataType.simpleString()
    rows = ranges.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for b in batches for row in zip(b.column(0), *(c.to_pylist() for c in b.columns[1:])))
        for conv_id, found in groupby(each, key=itemgetter(0)):
            repair = Repair()
            for _, piece in groupby(found, key=itemgetter(1)):
                repair.join({(entry, name): (cost, audit) for _, _, entry, name, cost, audit in piece})
            cost, audit = repair.result()
            yield pa.RecordBatch.from_arrays([pa.array([conv_id.as_py()], conv_id.type), pa.array([cost]), pa.array([audit])], names=["conv_id", "cost", "audit"])

    return rows.mapInArrow(run, f"conv_id {kind}, cost long, audit string")
