"""Quality rules: base counts of a text, and its divergence from the reference of its language.

Two histograms describe a text: its characters by class, and its words by a list of common words
(all others form one bin). The reference of a language is the median of each bin over its distinct
contents that pass the base rule, each histogram weighted one, so that neither copies, long texts nor
a junk group of less than half of the contents move it far. A text is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of either histogram to the
reference is above a threshold; texts below a minimum length are not judged by that histogram.

Defined results: a null text is empty and fails the base rule; a text whose language is null or has
no word list, or in which no text passes the base rule, is judged by the base rule alone; contents are
equal when their words are; rows are judged one by one, so repeated rows get the
same verdict; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermill.llm.shared import ship
from ledgermill.llm.text_arrays import Words, windows, words_of

# Frequent words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you were all their one we would will there who been has when if no".split(),
    "fr": "de la le et les des en un une du que qui est dans pour pas sur au plus par avec ce il sont son se ou mais nous vous elle aux cette ses".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wird sie nach einer um am sind noch wie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ha me si sin sobre este ya entre".split(),
}
# The classes of characters, by their bytes.
CLASSES = ("space", "lower", "upper", "digit", "punctuation", "symbol", "beyond_ascii", "other")
_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b".,;:'\"!?-()"

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Thresholds of the two distances, and the lengths from which they apply.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.25, 300
MAX_WORD_DISTANCE, MIN_COMMON_WORDS = 0.31, 100

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = ", ".join(f"{c}: bigint" for c in COUNTS) + ", base_failed: boolean, kept: boolean, class_distance: double, word_distance: double"

_PART = 1 << 20
#: Shares of a histogram are whole numbers up to this.
LEVELS = 10_000

_CLASS_OF = np.full(256, 7, dtype=np.int64)
_CLASS_OF[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS_OF[97:123], _CLASS_OF[65:91], _CLASS_OF[48:58], _CLASS_OF[0xC0:] = 1, 2, 3, 6
_CLASS_OF[list(_PUNCTUATION)], _CLASS_OF[list(_SYMBOLS)] = 4, 5
_CLASS_OF[0x80:0xC0] = len(CLASSES)  # later bytes of a character count for nothing


def _common_table() -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the common words, also capitalised, and the bin of each."""
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    forms = [f for w in words for f in (w, w.capitalize())]
    block = next(words_of(pa.array([" ".join(forms)])))
    hashes, order = np.unique(block.hashes(), return_index=True)
    return hashes, order // 2, len(words)


_TABLE: list[tuple[np.ndarray, np.ndarray, int]] = []


def _histograms(block: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters by class and words by common word, a row for each text."""
    if not _TABLE:
        _TABLE.append(_common_table())
    known, bins, n_bins = _TABLE[0]
    n, width = len(block.offsets) - 1, len(CLASSES) + 1
    if n == 1:  # a very long text is counted in parts
        classes = sum(np.bincount(_CLASS_OF[block.data[a : a + _PART]], minlength=width) for a in range(0, max(1, len(block.data)), _PART))[None, :-1]
    else:
        text_of = np.repeat(np.arange(n), np.diff(block.offsets))
        classes = np.bincount(text_of * width + _CLASS_OF[block.data], minlength=n * width).reshape(n, width)[:, :-1]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    word_bin = np.where(known[at] == hashes, bins[at], n_bins)
    text_of = np.repeat(np.arange(n), np.diff(block.bounds))
    return classes, np.bincount(text_of * (n_bins + 1) + word_bin, minlength=n * (n_bins + 1)).reshape(n, n_bins + 1)


def _repeated(window: np.ndarray, size: int) -> int:
    """Words in windows that occur twice or more."""
    order = np.argsort(window, kind="stable")
    same = np.zeros(len(window), dtype=bool)
    equal = window[order[1:]] == window[order[:-1]]
    same[order[1:][equal]] = True
    same[order[:-1][equal]] = True
    if not same.any():
        return 0
    edge = np.zeros(len(window) + size, dtype=np.int64)
    edge[:-size] += same
    edge[size:] -= same
    return int((np.cumsum(edge) > 0).sum())


def _base(block: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words in repeated windows, and whether the base rule rejects, for each text."""
    n_words = np.diff(block.bounds)
    repeats = np.zeros(len(n_words), np.int64)
    for i in np.flatnonzero(n_words > 5):
        repeats[i] = _repeated(windows(hashes[block.bounds[i] : block.bounds[i + 1]]), 5)
    return n_words, repeats, (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the same row of reference (rows of no mass: 0)."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    full = (p.sum(axis=1) > 0) & (q.sum(axis=1) > 0)
    return np.where(full, np.sqrt(np.maximum(part.sum(axis=1) / 2, 0)), 0.0)


def language_references(docs: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Histograms of all documents of each listed language: as many rows reach the driver as there are word lists."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for block in words_of(batch.column(1)):
                classes, common = _histograms(block, block.hashes())
                here = lang[block.first : block.first + len(classes)]
                for name in set(here):
                    at = here == name
                    sums = total.setdefault(name, [np.zeros(classes.shape[1], np.int64), np.zeros(common.shape[1], np.int64)])
                    sums[0] += classes[at].sum(axis=0)
                    sums[1] += common[at].sum(axis=0)
        rows = [(name, kind, k, int(v)) for name, sums in total.items() for kind, row in enumerate(sums) for k, v in enumerate(row)]
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "kind", "bin", "n"), r)) for r in rows], schema=pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))

    known = docs.where(F.col("lang").isin(sorted(COMMON_WORDS))).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    parts = known.mapInArrow(summed, "lang string, kind int, bin int, n bigint")
    rows = parts.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    found: dict[str, tuple[dict[int, int], dict[int, int]]] = {}
    for r in rows.collect():  # at most languages x bins
        found.setdefault(r["lang"], ({}, {}))[r["kind"]][r["bin"]] = r["n"]
    return {name: tuple([bins[k] for k in sorted(bins)] for bins in both) for name, both in found.items()}


def central_references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Medians, by bin, of the shares in LEVELS of each listed language's distinct contents that pass the base rule.

    As many rows reach the driver as there are word lists and bins; what is shuffled of a content is its digest
    and four bytes for each bin that it fills.
    """
    pair = np.dtype([("bin", "<u2"), ("level", "<u2")])
    names = sorted(COMMON_WORDS)
    n_bins = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1 + len(CLASSES)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digests, packed = [], [], []
            for block in words_of(batch.column(1)):
                hashes = block.hashes()
                passed = np.flatnonzero(~_base(block, hashes)[2])
                both = [(2 * LEVELS * x + x.sum(axis=1, keepdims=True)) // np.maximum(2 * x.sum(axis=1, keepdims=True), 1) for x in _histograms(block, hashes)]
                found = np.concatenate(both, axis=1)
                for i in passed:
                    bins = np.flatnonzero(found[i])
                    row = np.empty(len(bins), dtype=pair)
                    row["bin"], row["level"] = bins, found[i, bins]
                    at.append(block.first + i)
                    digests.append(hashlib.md5(hashes[block.bounds[i] : block.bounds[i + 1]].tobytes(), usedforsecurity=False).digest())
                    packed.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["lang", "content", "levels"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in set(lang):
                packed = batch.column(1).filter(pa.array(lang == name))
                pairs = np.frombuffer(b"".join(packed.to_pylist()), dtype=pair)
                places, n = np.unique(pairs["bin"].astype(np.int64) * (LEVELS + 1) + pairs["level"], return_counts=True)
                table = counts.setdefault(name, np.zeros((n_bins, LEVELS + 1), np.int64))
                table.reshape(-1)[places] += n
                empty = len(packed) - np.bincount(pairs["bin"], minlength=n_bins)
                table[:, 0] += empty
        for name, table in counts.items():
            bins, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(at, pa.int32()), pa.array(table[bins, at])], names=["lang", "bin", "level", "n"])

    known = docs.where(F.col("lang").isin(names)).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    contents = known.mapInArrow(levels, "lang string, content binary, levels binary")
    distinct = contents.groupBy("lang", "content").agg(F.min("levels").alias("levels")).select("lang", "levels")
    parts = distinct.mapInArrow(counted, "lang string, bin int, level int, n bigint")
    rows = parts.groupBy("lang", "bin").agg(F.percentile("level", F.lit(0.5), F.col("n")).alias("median"))
    found: dict[str, list[float]] = {}
    for r in rows.collect():  # at most languages x bins
        found.setdefault(r["lang"], [0.0] * n_bins)[r["bin"]] = r["median"]
    return {name: (bins[: len(CLASSES)], bins[len(CLASSES) :]) for name, bins in found.items()}


def quality_rules(
    docs: DataFrame,
    references: dict[str, tuple[list[float], list[float]]] | None = None,
    column: str = "quality",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_common_words: int = MIN_COMMON_WORDS,
) -> DataFrame:
    """docs (text, lang and any other columns) with a struct ``column`` of FIELDS added, without a shuffle of texts.

    A column of that name in docs is replaced. ``references`` default to the medians of docs itself.
    """
    ship(docs.sparkSession)
    references = central_references(docs) if references is None else references
    docs = docs.drop(column)
    text_at, lang_at = ([c.lower() for c in docs.columns].index(c) for c in ("text", "lang"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_judged(block, np.array(batch.column(lang_at).slice(block.first, len(block.offsets) - 1).to_pylist(), dtype=object)) for block in words_of(batch.column(text_at))]
            if parts:
                fields = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                added = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
                yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, column])

    def _judged(block: Words, lang: np.ndarray) -> dict[str, np.ndarray]:
        hashes = block.hashes()
        classes, common = _histograms(block, hashes)
        n = len(classes)
        n_words, repeats, failed = _base(block, hashes)
        chars = classes.sum(axis=1)
        lines = np.zeros(n, np.int64)
        newline = np.flatnonzero(block.data == 10)
        several = np.diff(np.searchsorted(newline, block.offsets)) > 0
        for i in range(n):
            if several[i]:
                lines[i] = _duplicate_lines(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes())
        refs = [[references[x][k] if x in references else [0] * width for x in lang] for k, width in enumerate((classes.shape[1], common.shape[1]))]
        by_class = np.where(chars >= min_chars, js_distance(classes, np.array(refs[0], dtype=np.float64).reshape(classes.shape)), 0.0)
        by_word = np.where(n_words >= min_common_words, js_distance(common, np.array(refs[1], dtype=np.float64).reshape(common.shape)), 0.0)
        kept = ~failed & (by_class <= max_class_distance) & (by_word <= max_word_distance)
        return {"n_words": n_words, "word_chars": chars - classes[:, 0], "n_symbols": classes[:, 5], "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": failed, "kept": kept, "class_distance": by_class, "word_distance": by_word}

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField(column, T.StructType.fromDDL(FIELDS))]))
