"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece has a white space marker after another character, pieces cannot cross from a word to
the marker that follows it, and the merges inside ``marker(s) + word`` depend on that chunk alone. So:

1. A task takes its texts in blocks of about BLOCK_CHARS and gives out the distinct chunks of each block,
   packed by a hash of the chunk: requests.
2. Requests are shuffled by that hash and sorted by it. A chunk comes to one task, whichever blocks ask for it, and
   all requests of its part follow each other, so it is segmented there once; the ids go back packed in the order of
   the request.
3. Replies are shuffled by block and written as one file for each block.
4. The texts are read again. A block's file gives the ids of its chunks, which are joined to the
   chunks of the texts in the order of their positions.

What is shuffled is some ten bytes for each distinct chunk of a block, never a text or a word for each
time that it occurs. A reply names its request by a digest: should a block hold other texts the second
time, or its file be missing, the task segments the chunks itself, so the result never depends on it.
A task's table over TABLE_ENTRIES is started anew, so its memory is bounded.

A model whose pieces can cross markers, that normalises texts or that has user-defined pieces is
refused.

Defined results: a null or empty text has no ids and decodes to an empty text; every row is encoded
by itself, so ties, repeated rows and null ids need no rule; an empty table gives an empty result;
columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.shard_files import committed, split_uri
from ledgermill.llm.shared import partitions_of, shared_dir, ship, stage

MARK = "▁"
TABLE_ENTRIES = 150_000
#: Tasks of the requests, at least, and parts in each: a task takes one part after the other, each with a table of its own,
#: so chunks are segmented once up to TABLE_ENTRIES x parts distinct ones: 300 million at 128 tasks, 24 billion at 10,000.
LEAST_TASKS, TASK_PARTS = 128, 16
#: Characters of texts in a block, and of texts encoded at once.
BLOCK_CHARS, ENCODE_CHARS = 16_000_000, 200_000
_CHUNKS = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")


class PieceTable:
    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces if not p.startswith("<")):
            raise ValueError("pieces of this model cross white space markers")
        if any(self.model.encode(s, out_type=str) != want for s, want in (("a", [MARK + "a"]), ("", []))) or self.model.decode(self.model.encode(" a  b ")) != " a  b ":
            raise ValueError("this model normalises white space")
        self.mark_id = self.model.piece_to_id(MARK)
        self.guard = self.model.encode("a")
        self.table: dict[str, tuple[int, bytes, str]] = {}
        self.taken = 0  # entries that were segmented elsewhere

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The model puts the first marker of a text; a chunk without one is segmented behind a line break."""
        marked = [c.startswith(MARK) for c in chunks]
        head = self.model.encode("\n")
        found = self.model.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)], num_threads=1)
        out = []
        for chunk, m, ids in zip(chunks, marked, found):
            if chunk == MARK:
                ids = [self.mark_id]
            elif not m:
                if ids[: len(head)] != head:
                    raise ValueError("pieces of this model cross line breaks")
                ids = ids[len(head) :]
            out.append(ids)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Puts chunks in the table: number of ids, ids in decimal joined by commas, the text that they decode to."""
        new = chunks.difference(self.table)
        if len(self.table) + len(new) > TABLE_ENTRIES + self.taken:
            self.table.clear()
            self.taken = 0
            new = chunks
        new = list(new)
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = self._segment(some)
            texts = self.model.decode([self.guard + i for i in ids], num_threads=1)
            self.table.update((c, (len(i), ",".join(map(str, i)).encode(), t[1:])) for c, i, t in zip(some, ids, texts))

    def take(self, chunks: list[str], counts: list[int], ids: list[bytes]) -> None:
        """Puts chunks in the table with their ids as segmented elsewhere; negative counts mark those whose text is decoded here."""
        for chunk, n, joined in zip(chunks, counts, ids):
            text = chunk.replace(MARK, " ") if n >= 0 else self.model.decode([*self.guard, *map(int, joined.split(b","))])[1:]
            self.table[chunk] = (abs(n), joined, text)
        self.taken += len(chunks)

    def clear(self) -> None:
        self.table, self.taken = {}, 0

    def chunks(self, text: str) -> list[str]:
        return _CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """Of each text the number of ids, the ids in decimal joined by commas, and the decoded text."""
        chunks = [self.chunks(t) for t in texts]
        try:
            found = [list(map(self.table.__getitem__, cs)) for cs in chunks]
        except KeyError:
            self.learn(set().union(*chunks))
            found = [list(map(self.table.__getitem__, cs)) for cs in chunks]
        out = []
        for rows in found:
            counts, ids, pieces = zip(*rows) if rows else ((), (), ())
            out.append((sum(counts), b",".join(ids), "".join(pieces)[1:]))
        return out


_tables: dict[str, PieceTable] = {}


def _table(model_path: str) -> PieceTable:
    if model_path not in _tables:
        _tables[model_path] = PieceTable(model_path)
    return _tables[model_path]


def _requests(table: PieceTable, texts: list[str], n_parts: int) -> dict[int, list[str]]:
    """The distinct chunks of texts by part, as they first occur. Chunks with a zero character, which parts them in a request, are left out."""
    found: dict[str, None] = {}
    for text in texts:
        found.update(dict.fromkeys(table.chunks(text)))
    parts: dict[int, list[str]] = {}
    for chunk in found:
        if "\0" not in chunk:
            parts.setdefault(zlib.crc32(chunk.encode()) % n_parts, []).append(chunk)
    return parts


def _digest(chunks: bytes) -> bytes:
    return hashlib.md5(chunks, usedforsecurity=False).digest()


def _text_blocks(batches: Iterator[pa.RecordBatch], column: int, block_chars: int) -> Iterator[tuple[int, list[str], list[pa.RecordBatch]]]:
    """Number, texts and batches of each block of a task. A block ends with a batch."""
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = number = 0
    for batch in batches:
        own = [v.as_py() or "" for v in batch.column(column)]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size >= block_chars:
            yield first + number, texts, held
            held, texts, size, number = [], [], 0, number + 1
    if held:
        yield first + number, texts, held


def _reply(table: PieceTable, raw: bytes) -> tuple[bytes, bytes]:
    """Of the chunks of a request their numbers of ids, negative where the decoded text is not the chunk itself, and the ids in decimal, a semicolon between chunks."""
    chunks = raw.decode().split("\0")
    table.learn(set(chunks))
    rows = [table.table[c] for c in chunks]
    counts = [n if text == chunk.replace(MARK, " ") else -n for chunk, (n, _, text) in zip(chunks, rows)]
    return np.array(counts, dtype="<i4").tobytes(), b";".join([joined for _, joined, _ in rows])


def _tasks(spark: SparkSession) -> int:
    return max(partitions_of(spark), LEAST_TASKS)


def _segmented(batches: Iterator[pa.RecordBatch], table: PieceTable) -> Iterator[pa.RecordBatch]:
    """The replies to requests (part, block, chunks) that come part by part: the table holds the chunks of one part."""
    current = None
    for batch in batches:
        requests, replies = batch.column(2).to_pylist(), []
        for part, raw in zip(batch.column(0).to_pylist(), requests):
            if part != current:
                table.clear()
                current = part
            replies.append(_reply(table, raw))
        columns = [batch.column(0), batch.column(1), pa.array([_digest(r) for r in requests], pa.binary()), *(pa.array([r[k] for r in replies], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "request", "counts", "ids"])


def build_table(docs: DataFrame, model_path: str, folder: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Segments the distinct chunks of docs (text) and writes the replies of each block below folder; block and n_chunks of each."""
    spark = docs.sparkSession
    ship(spark)
    n_tasks = _tasks(spark)
    n_parts = n_tasks * TASK_PARTS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for block, texts, _ in _text_blocks(batches, 0, block_chars):
            parts = _requests(table, texts, n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(["\0".join(c).encode() for c in parts.values()], pa.binary())], names=["part", "block", "chunks"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segmented(batches, _table(model_path))

    def write(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        with committed(f"{folder}/block-{block}", TaskContext.get().taskAttemptId()) as out, pa.ipc.new_stream(out, group.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(group)
        return pa.table({"block": pa.array([block], pa.int64()), "n_chunks": pa.array([sum(len(c) // 4 for c in group.column("counts").to_pylist())], pa.int64())})

    asked = docs.select(F.col("text").cast("string")).mapInArrow(ask, "part int, block bigint, chunks binary")
    replied = asked.repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(segment, "part int, block bigint, request binary, counts binary, ids binary")
    return replied.groupBy("block").applyInArrow(write, "block bigint, n_chunks bigint")


def _encoded_blocks(batches: Iterator[pa.RecordBatch], column: int, model_path: str, folder: str, n_parts: int, block_chars: int) -> Iterator[tuple[list[tuple[int, bytes, str]], list[pa.RecordBatch]]]:
    """Of each block of a task what PieceTable.encode gives for its texts, and its batches."""
    table = _table(model_path)
    for block, texts, held in _text_blocks(batches, column, block_chars):
        table.clear()
        files, path = split_uri(f"{folder}/block-{block}")
        if files.get_file_info(path).is_file:
            with files.open_input_stream(path, compression=None) as source:
                replies = {r["part"]: r for r in pa.ipc.open_stream(source).read_all().to_pylist()}
            for part, chunks in _requests(table, texts, n_parts).items():
                reply = replies.get(part)
                if reply is not None and reply["request"] == _digest("\0".join(chunks).encode()):
                    table.take(chunks, np.frombuffer(reply["counts"], "<i4").tolist(), reply["ids"].split(b";"))
        out = [row for some in _blocks(texts, ENCODE_CHARS) for row in table.encode(some)]
        table.clear()
        yield out, held


def _blocks(values: Iterable[str], chars: int) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for value in values:
        held.append(value)
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encode(docs: DataFrame, model_path: str, results: Callable[[list[tuple[int, bytes, str]]], list[pa.Array]], names: list[str], ddl: str, block_chars: int) -> DataFrame:
    """doc_id and the columns that results makes of the encoded rows."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/pieces"
    n_parts = _tasks(spark) * TASK_PARTS
    stage(build_table(docs, model_path, folder, block_chars))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held in _encoded_blocks(batches, 1, model_path, folder, n_parts, block_chars):
            at = 0
            for batch in held:
                own = rows[at : at + batch.num_rows]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), *results(own)], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, f"doc_id bigint, {ddl}")


def piece_digests(docs: DataFrame, model_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def results(rows: list[tuple[int, bytes, str]]) -> list[pa.Array]:
        digests = [[hashlib.sha256(x).hexdigest() for x in column] for column in ([joined for _, joined, _ in rows], [text.encode() for *_, text in rows])]
        return [pa.array([n for n, _, _ in rows], pa.int64()), *(pa.array(d, pa.string()) for d in digests)]

    return _encode(docs, model_path, results, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", block_chars)


def encode_documents(docs: DataFrame, model_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (array) and decoded text of every row."""

    def results(rows: list[tuple[int, bytes, str]]) -> list[pa.Array]:
        ids = [[int(x) for x in joined.split(b",")] if joined else [] for _, joined, _ in rows]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([text for *_, text in rows], pa.string())]

    return _encode(docs, model_path, results, ["ids", "decoded"], "ids array<int>, decoded string", block_chars)
