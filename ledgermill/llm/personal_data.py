"""Personal data in texts: fixed patterns, and a chain model over word shapes for what they miss.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers with a
country prefix. The model is a linear-chain conditional random field trained on TRAINING_LINES
labelled lines; it labels every word of every line and adds e-mail addresses spelled out, phone numbers
without prefix, personal numbers and secrets. What it adds must have the form of its kind (digits,
an at and a dot, length), but no list of words is asked after it. A span that the model adds never
overlaps one of the patterns.

Texts are searched in segments of SEGMENT characters, or of one longer word, with words of context on
either side, so memory does not grow with a text beyond its own size.

Spans count code points, the end is exclusive.

Defined results: a null text is empty and has no spans; every row is searched by itself, so ties,
repeated rows and null ids need no rule; an empty table gives an empty result; columns beside doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.crf import WIDTH, ChainCRF, Sequences, feature
from ledgermill.llm.labelled_contacts import KINDS, labelled_contacts
from ledgermill.llm.shared import ship
from ledgermill.llm.text_arrays import text_buffer

TRAINING_LINES = 7000
#: Characters of a line that are searched at once, the context taken around them, and words decoded at once.
SEGMENT, CONTEXT, DECODE_WORDS = 20_000, 600, 20_000
_SPACES = " \t\n\x0b\x0c\r"
_WORD, _GAP = re.compile(rf"[^{_SPACES}]+"), re.compile(rf"[{_SPACES}]")
#: A score that no sum of weights comes near.
_NEVER = np.float32(1e6)

BASE_KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*BASE_KINDS, "id", "secret")
# Characters before the at sign, and what follows it.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# no match can begin inside a run of digits, so that long runs take linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\[({<_](?:at|dot)[\])}>_]|\b(?:dot|punkt|punto|point|arroba|arobase)\b", re.I)
_ENDS = "com|org|net|edu|info|de|fr|es|io|eu|ch|at|gov|uk"
_NAMES = "pass|word|secret|token|key|kennwort|schlüssel|clave|contraseña|pwd"
_CUE = re.compile(rf"@|{_SPELLED.pattern}|\w\.(?:{_ENDS})\b|(?:{_NAMES})\S{{0,4}}[^\S\n]*[:=]", re.I)
#: What a cue holds in lower case, and how far behind its begin.
_CUE_KEYS = [("@", 0), *((bracket + word, 0) for bracket in "[({<_" for word in ("at", "dot")), *((word, 0) for word in "dot punkt punto point arroba arobase".split()), *((f".{end}", 1) for end in _ENDS.split("|")), *((name, 0) for name in _NAMES.split("|"))]
_HOST_END = re.compile(rf"\w[.)\]](?:{_ENDS})\b", re.I)

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the addresses: around each at sign the whole run of _LOCAL before it and _DOMAIN after it."""
    at, done = text.find("@"), 0
    while at >= 0:
        before = text[done:at]
        start = len(before.rstrip(_LOCAL)) + done
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _is_byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str, has_digit: bool = True) -> list[Span]:
    """Spans of the fixed patterns, by kind as in BASE_KINDS, then start."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if has_digit:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if not 13 <= m.end() - m.start() <= 37:
                continue
            digits = re.sub(r"[\x20-]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _shape(word: str) -> str:
    return re.sub(r"[A-ZÄÖÜ]+", "A", re.sub(r"[^\W\d_A-ZÄÖÜ]+", "a", re.sub(r"[0-9]", "9", word[:24])))


_MARKS = ".,;:!?\"'()=#`"


def _bare(word: str) -> str:
    return word.lower().strip(_MARKS)


#: Digits as nines, and letters of ASCII by their case alone.
_FORMS = str.maketrans({c: "9" if c.isdigit() else "A" if c.isupper() else "a" for c in string.ascii_letters + string.digits})
#: Distinct forms whose features are kept between batches, and distinct words whose parts of scores are.
KEPT_FORMS, KEPT_WORDS = 50_000, 200_000
#: Steps to the neighbours whose shapes and words are features.
_SHAPE_STEPS, _WORD_STEPS = (-3, -2, -1, 1, 2, 3), (-2, -1, 1, 2)
_LEFT, _RIGHT, _FORM_FEATURES = 5, 3, 10
_RUNS = np.array([feature(f"run:{n}") for n in range(21)])
_EDGE_SHAPES = np.array([feature(f"shape{step}:-") for step in _SHAPE_STEPS])
_EDGE_WORDS = np.array([feature(f"word{step}:-") for step in _WORD_STEPS])


def _form_features(key: str) -> tuple[int, ...]:
    """Of a form, after a digit that tells whether the word is glued (1) and ends as a host (2): its digits, whether they are most of it, its own features (-1 where there is none), its shape as each neighbour sees it."""
    told, form = int(key[0]), key[1:]
    shape = _shape(form)
    coarse = re.sub(r"9+", "9", shape)
    count = sum(c.isdigit() for c in form)
    names = [f"shape:{shape}", f"coarse:{coarse}", f"digits:{min(count, 20)}", f"length:{min(len(form), 12)}:{min(len(form) // 16, 4)}", f"end:{form[-1] if not form[-1].isalnum() else ''}", f"first:{form[0] if not form[0].isalnum() else ''}"]
    if 0 < count < len(form):
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(form, form[1:]))
        names.append(f"mixed:{min(changes, 6)}:{min(len(form) // 8, 5)}")
    kinds = "".join(k for k, found in (("a", re.search("[a-z]", form)), ("A", re.search("[A-Z]", form)), ("9", count), ("#", re.search(r"[^\w.,;:'\"()]", form))) if found)
    names.append(f"kinds:{kinds}:{min(len(form) // 4, 10)}")
    if told & 1:
        names.append("glued")
    if told & 2:
        names.append("host end")
    own = [feature(n) for n in names]
    seen = [feature(f"shape{step}:{coarse if abs(step) > 1 else shape}") for step in _SHAPE_STEPS]
    return (count, count > 0 and count >= sum(c.isalpha() for c in form), *own, *[-1] * (_FORM_FEATURES - len(own)), *seen)


#: Checksums of the names' beginnings: a feature's number goes on from them.
_WORD0, _WORD1, _WORD2, _WORD3, _WORD4, _WORD5, _WORD6 = [crc32(name.encode()) for name in ("word:", "left:", "right:", *(f"word{step}:" for step in _WORD_STEPS))]


def _word_features(low: str) -> tuple[int, ...]:
    """Of a word in lower case the features of itself, of those right of it, of those left of it, and of its near neighbours; -1 where it is long."""
    if len(low) > 16:
        return (-1, -1, -1, *_EDGE_WORDS)
    name = low.encode()
    return (
        crc32(name, _WORD0) % WIDTH, crc32(name, _WORD1) % WIDTH, crc32(name, _WORD2) % WIDTH,
        crc32(name, _WORD3) % WIDTH, crc32(name, _WORD4) % WIDTH, crc32(name, _WORD5) % WIDTH, crc32(name, _WORD6) % WIDTH,
    )


_forms: dict[str, tuple[int, ...]] = {}


def _features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of distinct words: number and features of their forms, their lower case, features of that, and of what stands before = or :."""
    joined = " ".join(words)  # a word holds no space
    begins = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
    told = np.zeros(len(words), dtype=np.int64)
    for flag, pattern in ((1, _SPELLED), (2, _HOST_END)):
        told[np.searchsorted(begins, np.array([m.start() for m in pattern.finditer(joined)], dtype=np.int64), side="right") - 1] |= flag
    told[np.fromiter(map(len, words), np.int64, len(words)) <= 6] &= 2
    form, forms = _table_of([f"{flags}{form}" for flags, form in zip(told.tolist(), joined.translate(_FORMS).split(" "))], _forms, KEPT_FORMS, _form_features)
    bare = [w.strip(_MARKS) for w in joined.lower().split(" ")]
    lows = np.array([_word_features(low) for low in bare], dtype=np.int64)
    named = np.array([feature(f"before:{_bare(re.split('[=:]', w)[0])}") if "=" in w or ":" in w else -1 for w in words])
    return form, forms, bare, lows, named


def _table_of(values: list[str], kept: dict[str, tuple[int, ...]], bound: int, features: Callable[[str], tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and the features of these."""
    which, distinct = pd.factorize(np.array(values, dtype=object))
    if len(kept) + len(distinct) > bound:
        kept.clear()
    rows = []
    for value in distinct:
        row = kept.get(value)
        if row is None:
            row = kept[value] = features(value)
        rows.append(row)
    return which, np.array(rows, dtype=np.int64)


def word_features(runs: list[list[str]]) -> Sequences:
    """The features of the words of each run, computed once for each form of a word (digits and letters taken as equal) or each distinct word."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    if not bounds[-1]:
        return Sequences(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), bounds)
    word, words = pd.factorize(np.array([w for run in runs for w in run], dtype=object))
    form, forms, bare, of_words, named = _features_of(list(words))
    low, distinct = pd.factorize(np.array(bare, dtype=object))
    lows = np.zeros((len(distinct), of_words.shape[1]), dtype=np.int64)
    lows[low] = of_words
    form, low, named = form[word], low[word], named[word]
    n = len(word)
    at, sequence = np.arange(n), np.repeat(np.arange(len(runs)), lengths)
    first, last = bounds[sequence], bounds[sequence + 1]

    def neighbour(step: int) -> tuple[np.ndarray, np.ndarray]:
        to = at + step
        return np.clip(to, 0, n - 1), (to >= first) & (to < last)

    # digits of the run of words that hold more digits than letters
    count, numeric = forms[form, 0], forms[form, 1] > 0
    group = np.cumsum(np.concatenate(([True], ~numeric[1:] | ~numeric[:-1] | (sequence[1:] != sequence[:-1])))) - 1
    digits = np.bincount(group, weights=count)[group].astype(np.int64)
    columns = [*forms[form, 2 : 2 + _FORM_FEATURES].T, _RUNS[np.where(numeric, np.minimum(digits, 20), 0)], lows[low, 0], named]
    for side, steps in ((1, range(-1, -_LEFT - 1, -1)), (2, range(1, _RIGHT + 1))):
        seen: list[np.ndarray] = []  # a word that stands there twice is one feature
        for step in steps:
            to, inside = neighbour(step)
            other = np.where(inside, low[to], -1)
            repeated = np.zeros(n, dtype=bool)
            for before in seen:
                repeated |= before == other
            seen.append(other)
            columns.append(np.where(inside & ~repeated, lows[low[to], side], -1))
    for k, step in enumerate(_SHAPE_STEPS):
        to, inside = neighbour(step)
        columns.append(np.where(inside, forms[form[to], 2 + _FORM_FEATURES + k], _EDGE_SHAPES[k]))
    for k, step in enumerate(_WORD_STEPS):
        to, inside = neighbour(step)
        columns.append(np.where(inside, lows[low[to], 3 + k], _EDGE_WORDS[k]))
    table = np.stack(columns, axis=1)
    there = table >= 0
    return Sequences(table[there], np.concatenate(([0], np.cumsum(there.sum(axis=1)))), bounds)


def train(lines: list[tuple[list[str], list[int]]]) -> ChainCRF:
    labels = np.array([x for _, truth in lines for x in truth], dtype=np.int64)
    return ChainCRF(len(KINDS)).fit(word_features([words for words, _ in lines]), labels)


@lru_cache(maxsize=2)
def default_model(n_lines: int = TRAINING_LINES) -> ChainCRF:
    return train(labelled_contacts(n_lines))


def _cues(part: str) -> list[int]:
    """Begins of all that often leads to personal data but digits; no search is bounded by them. Keys are sought in lower case, which is far faster than _CUE by itself."""
    low = part.replace("İ", "i").lower()  # the one letter that is longer in lower case
    found = []
    for key, behind in _CUE_KEYS:
        at = low.find(key)
        while at >= 0:
            if at >= behind and _CUE.match(part, at - behind):
                found.append(at - behind)
            at = low.find(key, at + 1)
    return found


def _segments(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Whole lines, or parts of a line longer than SEGMENT: bounds, and bounds of a part with its context in the line. None of them cuts a word."""
    at = 0
    while at < len(text):
        stop = len(text) if at + SEGMENT >= len(text) else text.rfind("\n", at + 1, at + SEGMENT)
        if stop < 0:
            stop = text.find("\n", at + 1)
            stop = len(text) if stop < 0 else stop
        a = at
        while a < stop:
            b = _gap_after(text, a + SEGMENT, stop)
            yield a, b, _gap_before(text, a - CONTEXT, at), _gap_after(text, b + CONTEXT, stop)
            a = b
        at = stop


def _gap_after(text: str, at: int, stop: int) -> int:
    gap = _GAP.search(text, at, stop) if at < stop else None
    return gap.start() if gap else stop


def _gap_before(text: str, at: int, start: int) -> int:
    """The place behind the last gap before ``at``, sought in longer and longer steps."""
    step, to = CONTEXT, at
    while to > start:
        lo = max(start, to - step)
        last = max(text.rfind(c, lo, to) for c in _SPACES)
        if last >= 0:
            return last + 1
        to, step = lo, 2 * step
    return start


@dataclass
class _Words:
    """Words of a segment: their texts and bounds, and the number of each one's line; spans may begin from ``a`` to ``b``."""

    text: int
    a: int
    b: int
    words: list[str]
    starts: np.ndarray
    ends: np.ndarray
    line: np.ndarray


def _words(number: int, text: str) -> Iterator[_Words]:
    """All words of a text."""
    for a, b, left, right in _segments(text):
        part = text[left:right]
        # a byte for each character: all that parts words is ASCII
        codes = np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)
        space = np.concatenate(([True], (codes == 32) | (codes - np.uint8(9) < 5), [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        if len(edges):
            starts = edges[::2]
            yield _Words(number, a, b, _WORD.findall(part), starts + left, edges[1::2] + left, np.searchsorted(np.flatnonzero(codes == 10), starts))


class _Scorer:
    """Scores (word, label) of a model. The sum of the weights of all that a word adds to the scores of itself and of each neighbour is computed once for each distinct word."""

    #: What a word adds: to itself, to the words right of it (1, 2, 3 and more steps away), to those left of it, and the parts of these that count once.
    _OWN, _L1, _L2, _L3, _LEFT, _R1, _R2, _R3, _RIGHT = range(9)

    def __init__(self, model: ChainCRF):
        self.model, self.k = model, len(model.first)
        self.weights = np.concatenate((model.weights, np.zeros((1, self.k), dtype=np.float32)))  # feature -1 adds nothing
        self.runs = self.weights[_RUNS] - self.weights[_RUNS[0]]
        self._clear()

    def _clear(self) -> None:
        """Row 0 stands for the end of a run."""
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 9 * self.k), dtype=np.float32)
        self.facts = np.zeros((1024, 3), dtype=np.int64)  # digits, whether they are most of the word, and the number of its lower case
        self.lows: dict[str, int] = {}
        edge = self.table[0].reshape(9, self.k)
        for block, shape, word in ((self._L1, 2, 1), (self._L2, 1, 0), (self._L3, 0, None), (self._R1, 3, 2), (self._R2, 4, 3), (self._R3, 5, None)):
            edge[block] = self.weights[_EDGE_SHAPES[shape]] + (0 if word is None else self.weights[_EDGE_WORDS[word]])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The row of each word."""
        missing = list(set(words).difference(self.rows))
        if len(self.rows) + len(missing) > KEPT_WORDS and self.rows:
            self._clear()
            missing = list(set(words))
        if missing:
            self._add(missing)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        n, w = len(self.rows) + 1, self.weights
        form, forms, bare, lows, named = _features_of(words)
        shape = lambda i: w[forms[:, 2 + _FORM_FEATURES + i]][form]
        near = lambda i: w[lows[:, 3 + i]]
        left, right = w[lows[:, 1]], w[lows[:, 2]]
        own = w[forms[:, 2 : 2 + _FORM_FEATURES]].sum(axis=1)[form] + w[lows[:, 0]] + w[named] + w[_RUNS[0]]
        rows = np.concatenate((own, shape(2) + near(1) + left, shape(1) + near(0) + left, shape(0) + left, left, shape(3) + near(2) + right, shape(4) + near(3) + right, shape(5) + right, right), axis=1)
        while n + len(words) > len(self.table):
            self.table, self.facts = (np.concatenate((t, np.zeros_like(t))) for t in (self.table, self.facts))
        self.table[n : n + len(words)] = rows
        self.facts[n : n + len(words), :2] = forms[form, :2]
        self.facts[n : n + len(words), 2] = [self.lows.setdefault(x, len(self.lows) + 1) for x in bare]
        self.rows.update(zip(words, range(n, n + len(words))))

    def scores(self, row: np.ndarray) -> np.ndarray:
        """Of words by their rows, with _LEFT zeros around every run; those of the zeros are of no use."""
        n, k, pad = len(row), self.k, _LEFT
        wide = np.concatenate((np.zeros(pad, dtype=np.int64), row, np.zeros(pad, dtype=np.int64)))
        full = self.table[wide].reshape(-1, 9, k)
        out = full[pad : pad + n, self._OWN].copy()
        lefts, rights = (self._L1, self._L2, self._L3, self._LEFT, self._LEFT), (self._R1, self._R2, self._R3)
        for step, block in [(-i, b) for i, b in enumerate(lefts, 1)] + list(enumerate(rights, 1)):
            out += full[pad + step : pad + step + n, block]
        count, numeric, low = self.facts[wide].T
        # a word that stands twice on a side is one feature
        for sign, reach, block in ((-1, _LEFT, self._LEFT), (1, _RIGHT, self._RIGHT)):
            for i in range(2, reach + 1):
                far = low[pad + sign * i : pad + sign * i + n]
                again = np.zeros(n, dtype=bool)
                for j in range(1, i):
                    again |= far == low[pad + sign * j : pad + sign * j + n]
                where = np.flatnonzero(again & (far > 0) & (row > 0))
                out[where] -= full[where + pad + sign * i, block]
        # digits of the run of words that hold more digits than letters
        count, numeric = count[pad : pad + n], numeric[pad : pad + n] > 0
        where = np.flatnonzero(numeric)
        if len(where):
            group = np.cumsum(np.diff(where, prepend=where[0]) > 1)
            digits = np.bincount(group, weights=count[where])[group].astype(np.int64)
            out[where] += self.runs[np.minimum(digits, 20)]
        return out


def added_spans(texts: list[str], model: ChainCRF, scorer: _Scorer | None = None) -> list[list[Span]]:
    """Spans that the model finds in each text: every word of every line is labelled."""
    found: list[list[Span]] = [[] for _ in texts]
    scorer = scorer or _Scorer(model)
    held: list[_Words] = []
    size = 0
    for i, text in enumerate(texts):
        for words in _words(i, text):
            held.append(words)
            size += len(words.words)
            if size >= DECODE_WORDS:
                _decode(texts, held, scorer, found)
                held, size = [], 0
    _decode(texts, held, scorer, found)
    return found


def _decode(texts: list[str], held: list[_Words], scorer: _Scorer, found: list[list[Span]]) -> None:
    if not held:
        return
    model = scorer.model
    sizes = np.array([len(w.words) for w in held])
    source = np.repeat(np.arange(len(held)), sizes)
    starts, ends, line = (np.concatenate([getattr(w, c) for w in held]) for c in ("starts", "ends", "line"))
    first = np.concatenate(([True], (source[1:] != source[:-1]) | (line[1:] != line[:-1])))
    # lines stand _LEFT places apart
    place = np.arange(len(source)) + _LEFT * np.cumsum(first)
    row = np.zeros(place[-1] + _LEFT + 1, dtype=np.int64)
    row[place] = scorer.numbers([x for w in held for x in w.words])
    scores = scorer.scores(row)
    scores[row == 0, 0] = _NEVER  # no stretch of labels goes on from line to line
    scores[row == 0, 1:] = -_NEVER
    open_ = model.undecided(scores) & (row > 0)
    if not open_.any():
        return
    # what is undecided, with the word on either side, which has label 0
    near = open_.copy()
    near[1:] |= open_[:-1]
    near[:-1] |= open_[1:]
    near &= row > 0
    at = np.flatnonzero(near)
    some = scores[at].astype(np.float64)
    some[~open_[at], 1:] = -_NEVER
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    labels = model.best_labels(some, np.append(begins, len(at)))
    stretch = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
    which = np.full(len(row), -1)
    which[place] = np.arange(len(place))
    which = which[at]
    changes = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (stretch[1:] != stretch[:-1]))))
    for lo, hi in zip(changes.tolist(), np.append(changes[1:], len(labels)).tolist()):
        if labels[lo]:
            begin, end = which[lo], which[hi - 1]
            words, kind = held[source[begin]], KINDS[labels[lo]]
            if words.a <= starts[begin] < words.b:
                text = texts[words.text]
                a, b = _trimmed(text, kind, int(starts[begin]), int(ends[end]))
                if _plausible(kind, text[a:b]):
                    found[words.text].append((kind, a, b))


def _trimmed(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    if kind == "secret" and (named := re.match(r"[\w.-]{2,40}?[\"']?[=:]+(?=.{6})", part)):
        start += named.end()  # the name of a secret stands in the same word
        part = text[start:end]
    start += len(part) - len(part.lstrip("\"'<`("  if kind != "phone" else "\"'<`"))
    part = text[start:end]
    return start, end - (len(part) - len(part.rstrip(".,;:\"'>`)" if kind == "secret" else ".,;:!?\"'>`)")))


def _plausible(kind: str, part: str) -> bool:
    """The form that a span of the kind must have."""
    digits = sum(c.isdigit() for c in part)
    if kind == "email":
        return bool(re.search(r"@|\b[aä]t\b|_at_|arroba|arobase", part, re.I)) and bool(_SPELLED.search(part) or "." in part)
    if kind == "secret":
        return len(part) >= 6 and " " not in part
    return 7 <= digits <= 15 if kind == "phone" else digits >= 5


def all_spans(texts: list[str], has_digit: np.ndarray, model: ChainCRF, scorer: _Scorer | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans in order) of each text."""
    out = []
    for i, (text, more) in enumerate(zip(texts, added_spans(texts, model, scorer))):
        base = base_spans(text, bool(has_digit[i])) if has_digit[i] or "@" in text else []
        added = _clear_of(more, base)
        out.append((base, sorted(base + added, key=lambda s: (ALL_KINDS.index(s[0]), s[1]))))
    return out


def _clear_of(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of base."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = list(accumulate((b for _, b in taken), max))
    before = [bisect_left(starts, end) for _, _, end in spans]  # those that begin before a span ends
    return [s for s, n in zip(spans, before) if not n or ends[n - 1] <= s[1]]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (patterns), spans, n_added (model) and has_any of every row."""
    ship(docs.sparkSession)
    model = model or default_model()
    counts = [f"n_{k}" for k in BASE_KINDS]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            digit_at = np.flatnonzero((data >= 48) & (data <= 57))
            has_digit = np.diff(np.searchsorted(digit_at, bounds)) > 0
            rows = all_spans([v.as_py() or "" for v in batch.column(1)], has_digit, model, scorer)
            columns = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in BASE_KINDS]
            hashed = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = pa.array([_joined(every) for _, every in rows], pa.string())
            added = pa.array([len(every) - len(base) for base, every in rows], pa.int64())
            any_found = pa.array([bool(every) for _, every in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, hashed, spans, added, any_found], names=["doc_id", *counts, "base_sha256", "spans", "n_added", "has_any"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, f"doc_id bigint, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string, n_added bigint, has_any boolean")


def redact(docs: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; of overlapping spans the first in text order, then the longest, counts."""
    ship(docs.sparkSession)
    model = model or default_model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            out = []
            for text, (_, spans) in zip(texts, all_spans(texts, np.ones(len(texts), dtype=bool), model, scorer)):
                parts, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                        at = b
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id bigint, text string")
