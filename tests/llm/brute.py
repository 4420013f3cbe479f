"""The stages of the pipeline in plain Python over lists of rows (doc_id, text, lang, source), for comparison."""

import collections
import hashlib
import math
import re
import statistics

from ledgermill.llm import personal_data
from ledgermill.llm.quality_rules import COMMON_WORDS

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASSES = ("space", "lower", "upper", "digit", "punctuation", "symbol", "beyond_ascii", "other")


def base_failed(text):
    words = WORD.findall(text or "")
    spans = collections.defaultdict(list)
    for i in range(len(words) - 4):
        spans[tuple(words[i : i + 5])].append(i)
    covered = {k for at in spans.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return len(words) < 10 or 100 * len(covered) > 20 * len(words)


def _class_of(c):
    if c in "\x20\t\n\x0b\x0c\r":
        return "space"
    if c in ".,;:'\"!?-()":
        return "punctuation"
    if c in "#*$%&|<>":
        return "symbol"
    if ord(c) > 127:
        return "beyond_ascii"
    return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other"


def histograms(text):
    known = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    forms = {f: w for w in known for f in (w, w.capitalize())}
    classes, words = collections.Counter(map(_class_of, text or "")), collections.Counter(forms.get(w, "") for w in WORD.findall(text or ""))
    return [classes[c] for c in CLASSES], [words[w] for w in known] + [words[""]]


def distance(counts, reference):
    p, q = ([x / (sum(v) or 1) for x in v] for v in (counts, reference))
    if not sum(p) or not sum(q):
        return 0.0
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def quality(rows):
    """(kept, class distance, word distance) of each row."""
    contents = collections.defaultdict(dict)
    for _, text, lang, _ in rows:
        if lang in COMMON_WORDS and not base_failed(text):
            shares = [[(20_000 * x + sum(h)) // (2 * sum(h)) for x in h] for h in histograms(text)]
            contents[lang][tuple(WORD.findall(text))] = shares  # of two texts with the same words any one counts
    centre = {lang: [[statistics.median(column) for column in zip(*(s[k] for s in found.values()))] for k in (0, 1)] for lang, found in contents.items()}
    out = []
    for _, text, lang, _ in rows:
        classes, words = histograms(text)
        far = [distance(h, centre[lang][k]) if lang in centre and n >= least else 0.0 for k, (h, n, least) in enumerate(((classes, len(text or ""), 300), (words, sum(words), 100)))]
        out.append((not base_failed(text) and far[0] <= 0.25 and far[1] <= 0.31, *far))
    return out


def _first(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest()))


def exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", r[1] or "")].append(r)
    return [_first(g) for g in groups.values()]


def near(rows):
    sets = []
    for r in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set())
    holders, parent = collections.defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [_first(g) for g in groups.values()]


def mix(rows, targets):
    """Rows as often as the mix takes them; ``targets`` gives the target of each source from the sizes."""
    sizes, by_source = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        place = int(hashlib.md5(f"17:{'' if r[0] is None else r[0]}:{n}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16)
        by_source[r[3]].append((place, r[0] is None, r[0] or 0, n, r))
    aim, out = targets(sizes), []
    for source, placed in by_source.items():
        for epoch in range(2):
            at = epoch * sizes[source]
            for *_, n, r in sorted(placed, key=lambda x: x[:4]):
                if n and at + n / 2 <= aim[source]:
                    out.append(r)
                at += n
    return out


def word_features(words: list[str]) -> list[list[int]]:
    """The features of each word of a run, word by word."""
    shapes = [personal_data._shape(w) for w in words]
    coarse = [re.sub(r"9+", "9", s) for s in shapes]
    low = [personal_data._bare(w) for w in words]
    counts = [sum(c.isdigit() for c in w) for w in words]
    # digits of the run of words that hold more digits than letters
    numeric = [n > 0 and n >= sum(c.isalpha() for c in w) for n, w in zip(counts, words)]
    run, i = [0] * len(words), 0
    while i < len(words):
        j = i
        while j < len(words) and numeric[j]:
            j += 1
        run[i:j] = [sum(counts[i:j])] * (j - i)
        i = max(j, i + 1)
    rows = []
    for i, w in enumerate(words):
        names = [f"shape:{shapes[i]}", f"coarse:{coarse[i]}", f"digits:{min(counts[i], 20)}", f"run:{min(run[i], 20)}", f"length:{min(len(w), 12)}:{min(len(w) // 16, 4)}", f"end:{w[-1] if not w[-1].isalnum() else ''}", f"first:{w[0] if not w[0].isalnum() else ''}"]
        if counts[i] and counts[i] < len(w):
            changes = sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:]))
            names.append(f"mixed:{min(changes, 6)}:{min(len(w) // 8, 5)}")
        kinds = "".join(k for k, found in (("a", re.search("[a-z]", w)), ("A", re.search("[A-Z]", w)), ("9", counts[i]), ("#", re.search(r"[^\w.,;:'\"()]", w))) if found)
        names.append(f"kinds:{kinds}:{min(len(w) // 4, 10)}")
        if len(w) > 6 and personal_data._SPELLED.search(w):
            names.append("glued")
        if personal_data._HOST_END.search(w):
            names.append("host end")
        if len(low[i]) <= 16:
            names.append(f"word:{low[i]}")
        if "=" in w or ":" in w:
            names.append(f"before:{personal_data._bare(re.split('[=:]', w)[0])}")
        names += [f"left:{x}" for x in set(low[max(0, i - 5) : i]) if len(x) <= 16]
        names += [f"right:{x}" for x in set(low[i + 1 : i + 4]) if len(x) <= 16]
        for step in (-3, -2, -1, 1, 2, 3):
            j = i + step
            inside = 0 <= j < len(words)
            names.append(f"shape{step}:{coarse[j] if inside and abs(step) > 1 else shapes[j] if inside else '-'}")
            if abs(step) <= 2:
                names.append(f"word{step}:{low[j] if inside and len(low[j]) <= 16 else '-'}")
        rows.append([personal_data.feature(n) for n in names])
    return rows
