"""Token ids in binary shards, and a minimal perfect hash index from document keys to their places.

A shard holds documents in ascending doc_id order; shards follow each other in that order:

    magic (8 bytes) | ids, little-endian, 2 or 4 bytes each | table: doc_id (int64), number among
    rows of that id (uint32), start in the shard (uint64) per document | documents, ids (uint64),
    bytes of an id, bytes of a key (uint32), magic

The index is split by a hash of the key (doc_id, number). A part is a minimal perfect hash built in
levels: keys that are alone at their position of a level's bit array stay there, the others go on
to the next level; the slot of a key is the rank of its bit. Slots store a 32-bit fingerprint of the
key, shard, start and length, so a lookup touches one bit of each level passed and one slot, and
a foreign key is told by its fingerprint but for one in 2**32.

Words are encoded once by a table that each task keeps (see ``WordTable``).

Defined results: a null text is empty and consists of the end id; a null doc_id comes first and is
stored as the smallest int64; rows that share a doc_id are numbered in the order of their texts, and go
to several shards where they are many; an empty table writes no shard and gives an empty result. A part of the index or a shard that is lost is an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.shard_files import committed, split_uri
from ledgermill.llm.shared import partitions_of, shared_dir, ship, stage, text_or_empty
from ledgermill.llm.text_arrays import mix

MAGIC = b"LMSHARD1"
_TAIL = "<QQII8s"
_TAIL_BYTES = struct.calcsize(_TAIL)
_DOC = np.dtype([("doc_id", "<i8"), ("number", "<u4"), ("start", "<u8")])
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("length", "<u4")])
NULL_ID = -(1 << 63)
#: Characters of texts by which rows of one doc_id are dealt to shards. Whole texts are written, in the order of whole texts.
RANGE_CHARS = 64
#: Keys in one part of the index, on average.
PART_KEYS = 200_000
TABLE_ENTRIES = 400_000
#: New words encoded by one call of the library; its time for a word grows with the length of a text.
CALL_WORDS = 512

# The text handling that the table knows how to take apart.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters outside these may normalise, lower or split in ways left to the library.
_RARE = re.compile("[^\\t\\n\\r -~¡-įı-ſ‐-‧€]")
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\t\\n\\r {_LETTER}{_DIGIT}]+")


class WordTable:
    """Ids of texts, by a table of the distinct words met, where the tokenizer encodes words apart.

    Texts with characters beyond _RARE or with a special token's string, and all texts of other
    tokenizers, are encoded whole by the library. A table over TABLE_ENTRIES is started anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and bool(splits) and splits[0].get("pattern") == {"Regex": _SPLIT} and splits[0].get("behavior") == "Removed" and not spec["model"].get("dropout")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        vocabulary = self.library.get_vocab()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if self.suffix and token.endswith(self.suffix)]] = True
        self.table: dict[str, bytes] = {}

    def _apart(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one call over all of them: the suffix of a word's last token shows where it ends."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
        bounds = np.flatnonzero(self.ends[ids]) + 1
        if len(bounds) != len(words):
            return self._whole(words)
        raw, at = ids.tobytes(), (bounds * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        words: list[list[str] | None] = []
        for text in texts:
            plain = self.by_words and not _RARE.search(text) and not self.special.search(text)
            words.append(_WORDS.findall(text.lower()) if plain else None)
        table = self.table
        distinct = set().union(*(ws for ws in words if ws is not None))
        missing = list(distinct.difference(table))
        if missing:
            if len(table) + len(missing) > TABLE_ENTRIES:
                table.clear()
                missing = list(distinct)
            for lo in range(0, len(missing), CALL_WORDS):
                some = missing[lo : lo + CALL_WORDS]
                table.update(zip(some, self._apart(some)))
        return [self._whole([text])[0] if ws is None else b"".join(map(table.__getitem__, ws)) for text, ws in zip(texts, words)]


_tables: dict[str, WordTable] = {}


def _table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def _blocks(batch: pa.RecordBatch, chars: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    held: list[str] = []
    first = size = 0
    for i, value in enumerate(batch.column(1)):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> DataFrame:
    """Writes the shards below folder; of each shard, n_docs, n_ids, its first and last doc_id, and n_last rows of the last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer_path)
        task = TaskContext.get()
        shard, end = task.partitionId(), np.array([end_id], dtype=f"<u{table.width}").tobytes()
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        rows: list[np.ndarray] = []
        total, last, number = 0, None, 0
        with committed(f"{folder}/shard-{shard:06d}.ids", task.taskAttemptId()) as out:
            out.write(MAGIC)
            while batch is not None:
                ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                for first, texts in _blocks(batch):
                    table_rows = np.zeros(len(texts), dtype=_DOC)
                    for i, encoded in enumerate(table.encode(texts)):
                        doc_id = int(ids[first + i])
                        number = number + 1 if doc_id == last else 0
                        last = doc_id
                        table_rows[i] = (doc_id, number, total)
                        out.write(encoded + end)
                        total += len(encoded) // table.width + 1
                    rows.append(table_rows)
                batch = next(batches, None)
            documents = np.concatenate(rows)
            out.write(documents.tobytes())
            out.write(struct.pack(_TAIL, len(documents), total, table.width, _DOC.itemsize, MAGIC))
        facts = (len(documents), total, int(documents["doc_id"][0]), int(documents["doc_id"][-1]), int(documents["number"][-1]) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([f], pa.int64()) for f in facts)], names=["shard", "n_docs", "n_ids", "first_id", "last_id", "n_last"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(each, "shard int, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint, n_last bigint")


def _numbered_before(shards: DataFrame) -> DataFrame:
    """shard, before: rows of its first doc_id in the shards before it."""
    ends = [shards.select(F.col(f"{end}_id").alias("id"), "shard", added.alias("added"), F.lit(end == "first").alias("begins")) for end, added in (("first", F.lit(0).cast("bigint")), ("last", F.col("n_last")))]
    earlier = Window.partitionBy("id").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    return ends[0].union(ends[1]).withColumn("before", F.coalesce(F.sum("added").over(earlier), F.lit(0))).where("begins").select("shard", "before")


def _open_shard(folder: str, shard: int):
    files, path = split_uri(f"{folder}/shard-{shard:06d}.ids")
    source = files.open_input_file(path)
    tail = struct.unpack(_TAIL, source.read_at(_TAIL_BYTES, source.size() - _TAIL_BYTES))
    if tail[4] != MAGIC:
        raise ValueError(f"{path} is no shard")
    return source, tail


def shard_table(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, number, shard, start, length of every document, from the tables in the shard files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, (n_docs, n_ids, _, size, _) = _open_shard(folder, shard)
                with source:
                    docs = np.frombuffer(source.read_at(n_docs * size, source.size() - _TAIL_BYTES - n_docs * size), dtype=_DOC)
                lengths = np.diff(np.append(docs["start"].astype(np.int64), n_ids))
                number = docs["number"] + np.where(docs["doc_id"] == docs["doc_id"][0], before, 0)
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"].astype(np.int64)), pa.array(number.astype(np.int64)), pa.array(np.full(n_docs, shard, dtype=np.int32)), pa.array(docs["start"].astype(np.int64)), pa.array(lengths)], names=["doc_id", "number", "shard", "start", "length"])

    return _numbered_before(shards).repartition(max(1, shards.count())).mapInArrow(each, "doc_id bigint, number bigint, shard int, start bigint, length bigint")


def _key_hash(doc_id: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, and ranks."""

    FACTOR = 1.5

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # booleans
        self.ranks = [np.cumsum(bits) - bits for bits in levels]
        self.before = np.concatenate(([0], np.cumsum([int(b.sum()) for b in levels], dtype=np.int64)))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        levels = []
        while len(keys):
            size = max(8, int(cls.FACTOR * len(keys)))
            at = cls._place(keys, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, at, levels = struct.unpack_from("<I", raw)[0], 4, []
        for _ in range(n):
            size = struct.unpack_from("<Q", raw, at)[0]
            n_bytes = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, n_bytes, at + 8))[:size].astype(bool))
            at += 8 + n_bytes
        return cls(levels), at


def _part_of(n_parts: int):
    return F.pmod(F.xxhash64("doc_id", "number"), F.lit(n_parts)).cast("int")


def build_index(table: DataFrame, folder: str, n_parts: int) -> DataFrame:
    """Writes the index parts of a shard table below folder; part and n_keys of each."""

    def each(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        doc_id, number, shard, start, length = (group.column(c).to_numpy() for c in ("doc_id", "number", "shard", "start", "length"))
        keys = _key_hash(doc_id, number)
        index = PerfectHash.build(keys)
        slots = np.zeros(len(keys), dtype=_SLOT)
        at = index.slots(keys)
        for name, values in (("print", mix(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)), ("shard", shard), ("start", start), ("length", length)):
            slots[name][at] = values
        with committed(f"{folder}/index-{part:06d}.mph", TaskContext.get().taskAttemptId()) as out:
            out.write(index.to_bytes() + slots.tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64())})

    return table.withColumn("part", _part_of(n_parts)).groupBy("part").applyInArrow(each, "part int, n_keys bigint")


def lookup(keys: DataFrame, folder: str, n_parts: int, built: DataFrame) -> DataFrame:
    """keys (doc_id, number) with shard, start, length by the index; foreign keys have none. A part that build_index has written (``built``) must be there."""
    schema = pa.schema([("doc_id", pa.int64()), ("number", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])

    def each(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        doc_id, number = (group.column(c).to_numpy() for c in ("doc_id", "number"))
        if group.column("n_keys")[0].as_py() is not None:
            files, path = split_uri(f"{folder}/index-{part:06d}.mph")
            with files.open_input_stream(path, compression=None) as source:
                raw = source.read()
            index, at = PerfectHash.from_bytes(raw)
            slots = np.frombuffer(raw, dtype=_SLOT, offset=at)
            hashes = _key_hash(doc_id, number)
            place = index.slots(hashes)
            found = slots[np.maximum(place, 0)]
            known = (place >= 0) & (found["print"] == (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)))
        else:
            found, known = np.zeros(len(doc_id), dtype=_SLOT), np.zeros(len(doc_id), dtype=bool)
        columns = [pa.array(doc_id), pa.array(number), *(pa.array(found[c].astype(np.int64), mask=~known) for c in ("shard", "start", "length"))]
        return pa.table(columns, names=schema.names).cast(schema)

    dealt = keys.withColumn("part", _part_of(n_parts)).join(built, "part", "left")
    return dealt.groupBy("part").applyInArrow(each, "doc_id bigint, number bigint, shard int, start bigint, length bigint")


def read_ids(places: DataFrame, folder: str, n_shards: int) -> DataFrame:
    """doc_id, number, shard, start, n_tokens, ids_crc32 of looked-up places, from the payloads at their offsets. A key without a place raises an error."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, current, width = None, None, 0
        for batch in batches:
            shards, starts, lengths = (batch.column(c).to_numpy() for c in (2, 3, 4))
            sums = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(batch.num_rows):
                if shards[i] != current:
                    if source is not None:
                        source.close()
                    current = shards[i]
                    source, (_, _, width, _, _) = _open_shard(folder, int(current))
                raw = source.read_at(int(lengths[i]) * width, len(MAGIC) + int(starts[i]) * width)
                sums[i] = zlib.crc32(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, "ids_crc32"])
        if source is not None:
            source.close()

    # a given number of partitions is not merged, though the places are far smaller than the payloads they lead to
    known = F.coalesce("shard", F.raise_error(F.lit("the index has no place for a document")).cast("int"))
    ordered = places.withColumn("shard", known).repartition(max(1, n_shards), "shard").sortWithinPartitions("shard", "start")
    return ordered.select("doc_id", "number", "shard", "start", "length").mapInArrow(each, "doc_id bigint, number bigint, shard int, start bigint, length bigint, ids_crc32 bigint")


def encode_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes shards and index, and reads every document back by its key: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids"
    shards = stage(write_shards(docs, tokenizer_path, end_id, folder))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(F.col("shard").alias("base_shard"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n_docs, n_shards = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.lit(1))).first()
    n_parts = max(partitions_of(spark), n_docs // PART_KEYS + 1)
    table = shard_table(shards, folder)
    built = stage(build_index(table, folder, n_parts))
    read = read_ids(lookup(table.select("doc_id", "number"), folder, n_parts, built), folder, n_shards)
    joined = read.join(bases, F.col("shard") == F.col("base_shard"))
    return joined.select(
        F.when(F.col("doc_id") != F.lit(NULL_ID), F.col("doc_id")).alias("doc_id"),
        (F.col("base") + F.col("start")).alias("start"),
        F.col("length").alias("n_tokens"),
        "ids_crc32",
        "shard",
    )
