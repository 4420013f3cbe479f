"""Words and their hashes of a whole Arrow batch of texts, as numpy arrays.

The texts of a batch lie in one byte buffer. White space is found by a table lookup, words are
its gaps, and the hash of a word comes from prefix sums of a polynomial over the bytes, so that
no Python code runs for a single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multipliers of the words of a window, by place.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Bytes hashed at once: a very long text takes several turns.
SEGMENT = 4 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < length:
        size = max(1 << 16, 1 << int(length - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have[:length]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of texts first..first+n-1 of a batch. Offsets are bytes of ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # n + 1 text bounds
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] up to bounds[i + 1]

    def hashes(self) -> np.ndarray:
        """A hash of each word, the same wherever it stands."""
        parts, i, n = [], 0, len(self.starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SEGMENT, side="right")))
            parts.append(self._hashes(i, j))
            i = j
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def _hashes(self, i: int, j: int) -> np.ndarray:
        base = self.starts[i]
        data, starts, ends = self.data[base : self.ends[j - 1]], self.starts[i:j] - base, self.ends[i:j] - base
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(data))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _PLACES[0])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 bounds of its texts in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def words_of(column: pa.Array, lower: bool = False, block: int = 2 << 20) -> Iterator[Words]:
    """The words of all texts, in blocks of about ``block`` bytes; a longer text is a block of its own."""
    data, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, side="right")) - 1)
        part = data[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        yield _split(first, _LOWER[part] if lower else part, bounds)
        first = last


def _split(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    gap = _SPACE[data]
    opens = ~gap
    opens[1:] &= gap[:-1]
    closes = ~gap
    closes[:-1] &= gap[1:]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]  # where texts meet, words end
    opens[filled] |= ~gap[filled]
    ends_at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[ends_at] |= ~gap[ends_at]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words, or of the whole sequence when it is shorter."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    count = len(hashes) - size + 1
    total = np.full(count, size, dtype=np.uint64)
    for place in range(size):
        total += hashes[place : place + count] * _PLACES[place % 5] * np.uint64(2 * (place // 5) + 1)
    return mix(total)
