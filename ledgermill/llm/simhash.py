"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a few differing bits by a trie self-join.

A text is lower-cased in A-Z and cut into words; its shingles are three neighbouring words joined by spaces,
each as often as it occurs (a shorter text is one shingle, a text without words has none). A bit of the
fingerprint is set if more than half of the XXH64 values (seed 42) of the shingles have it.

Documents with one fingerprint are linked as they are; the distinct fingerprints meet in ``hamming_trie``, and
components of their links are found by ``graph``. Whole texts are read, a long one piece by piece.

Defined results: a null text and a text without words have fingerprint zero, which links like any other. A null
doc_id ranks after all others: a component of rows without ids has a null id. Repeated rows stay as they are. An
empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.exact_dedup import with_group
from ledgermill.llm.graph import connected_components
from ledgermill.llm.hamming_trie import hamming_links
from ledgermill.llm.shared import stage, text_or_empty

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; a piece starts with the last words of the one before, which its shingles need."""
    at, tail = 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = tail + data[at:end].split()  # of bytes, split() knows just the white space of the contract
        yield words
        at, tail = end, words[1 - SHINGLE :]


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    count, ones, few = 0, np.zeros(64, dtype=np.int64), []
    for words in _pieces(text.encode().lower()):
        if len(words) < SHINGLE:
            few = words
            continue
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        joined, starts = b" ".join(words), [0, *(e + 1 for e in ends[: -SHINGLE])]
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :])], dtype="<u8")
        count += len(hashes)
        ones += _ones(hashes)
    if not count and few:
        count, ones = 1, _ones(np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], dtype="<u8"))
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the values have each bit."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(of, f"doc_id {kind}, fp long")


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) of each row."""
    prints = stage(fingerprints(docs))
    n_rows = prints.count()
    groups = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_rows")))
    labels = connected_components(hamming_links(groups.select("fp"), radius))
    rooted = groups.join(labels, F.col("fp") == F.col("node"), "left").select("fp", F.col("first_id").alias("doc_id"), "group_rows", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted)
    components = stage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("group_rows")))
    known = with_group(rooted.select("doc_id", "fp", "root", F.col("group_rows").alias("fp_rows")), components, "root", rooted.count())
    known = stage(known.select("fp", "component_id", F.col("fp_rows").alias("group_rows")))
    return with_group(prints, known, "fp", n_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
