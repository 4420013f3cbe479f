import hashlib
import random
import re
import tracemalloc
from collections import Counter

import brute as plain
import numpy as np
from contact_lines import CLEAN, LINES

from ledgermill.llm.crf import Sequences
from ledgermill.llm.labelled_contacts import labelled_contacts
from ledgermill.llm.personal_data import _CUE, _clear_of, _cues, _Scorer, all_spans, base_spans, default_model, find_personal_data, redact, word_features


def brute(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_patterns_against_brute_force():
    rng = random.Random(2)
    parts = [*"ab@.-+ 0123456789()\n\té%", "a@b.c", "1.2.3.4", "+1 (234) 555-1234", "4111111111111111", "256.1.1.1", "4111-1111 1111-1111"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    n = 300_000
    assert base_spans("1" * n) == [] and base_spans("a" * n + "@") == [] and base_spans("@" * n) == []
    assert base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]
    assert base_spans("a" * n + "@b.c " + "a@b.c_x@d.e") == [("email", 0, n + 4), ("email", n + 5, n + 10), ("email", n + 10, n + 16)]


def test_query(documents, corpus):
    rows = find_personal_data(documents).collect()
    expected = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or "")).encode()).hexdigest()) for i, t in corpus)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == expected
    for r in rows:
        spans = [s for s in r["spans"].split(",") if s]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]


def test_model_on_held_out_lines():
    test = labelled_contacts(300, seed=77)
    found = default_model().decode(word_features([w for w, _ in test]))
    truth = np.concatenate([t for _, t in test])
    for label in (1, 2, 3, 4):
        right = ((found == label) & (truth == label)).sum()
        assert right / (found == label).sum() > 0.93 and right / (truth == label).sum() > 0.9


def test_features_word_by_word():
    """Also of runs of one word, of empty runs, of long and repeated words, of words beyond ASCII."""
    runs = [w for w, _ in labelled_contacts(200, seed=78)] + [[], ["a"], ["1"], ["1", "a", "1", "a", "1"], ["İ9", "Σ.", "ΑΣ", "x" * 17, "=:=", "²³", "k=v:w"], []]
    found, expected = word_features(runs), Sequences.of([plain.word_features(w) for w in runs])
    assert found.bounds.tolist() == expected.bounds.tolist() and found.starts.tolist() == expected.starts.tolist()
    for lo, hi in zip(found.starts, found.starts[1:]):
        assert sorted(found.ids[lo:hi]) == sorted(expected.ids[lo:hi])


def test_cues():
    """Every match of the pattern is found, and nothing that it does not match."""
    rng = random.Random(6)
    parts = ["@", "[at]", "(DOT)", "dot", " Dot ", "x.com", ".de", "İ", "Pass", "wort", "KEY", " ", ":", "=", "\n", "Schlüssel", "PUNKT", "arroba", "é"]
    for text in [line for line, *_ in LINES] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]:
        found = _cues(text)
        assert {m.start() for m in _CUE.finditer(text)} <= set(found) and all(_CUE.match(text, at) for at in found), text


def _found(lines):
    return [[(k, line[a:b]) for k, a, b in every] for line, (_, every) in zip(lines, all_spans(lines, np.ones(len(lines), dtype=bool), default_model()))]


def test_lines_written_by_hand():
    """Recall by whole spans on lines that the generator can not make, and lines without personal data."""
    found = _found([line for line, _ in LINES])
    assert sum(set(want) <= set(got) for (_, want), got in zip(LINES, found)) >= 0.9 * len(LINES)
    assert sum(bool(x) for x in _found(CLEAN)) <= 1


def test_added_spans():
    text = "The of. Write to anna dot le at example dot com or call (974) 555-3436 now. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    base, every = all_spans([text], np.array([True]), default_model())[0]
    assert base == [] and {(k, text[a:b]) for k, a, b in every} == {("email", "anna dot le at example dot com"), ("phone", "(974) 555-3436"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")}


def test_every_word_is_looked_at():
    """Addresses whose hosts end in no known way, and secrets of over 120 characters: no digit, at sign or cue leads to them."""
    long = "ab3d" * 40
    lines = ["You can write to anna at firma.xyz for more of it", "contact lisa at example.app", "mail karl at museum.berlin today", f"API key = {long} is ours"]
    assert _found(lines) == [[("email", "anna at firma.xyz")], [("email", "lisa at example.app")], [("email", "karl at museum.berlin")], [("secret", long)]]


def test_labels_are_those_of_whole_lines():
    """What is left out as decided has label 0 in the plain decoding of the whole line, and scores by words are those by features."""
    model, rng = default_model(), random.Random(8)
    runs = [[w for line, *_ in rng.choices(labelled_contacts(60, seed=79), k=3) for w in line] for _ in range(40)] + [["a"], ["a", "a", "1", "a", "1 "[0]], ["x" * 300, "1"]]
    data, scorer, rows = word_features(runs), _Scorer(model), []
    place = []
    for run in runs:
        rows += [0] * 5
        place += range(len(rows), len(rows) + len(run))
        rows += scorer.numbers(run).tolist()
    found = scorer.scores(np.array(rows + [0] * 5))
    assert np.abs(found[place] - model._scores(data)).max() < 1e-4
    found[np.array(rows + [0] * 5) == 0] = [1e6, *[-1e6] * (found.shape[1] - 1)]
    open_ = model.undecided(found)[place]
    assert not (model.decode(data)[~open_]).any() and open_.mean() < 0.9


def test_spans_do_not_depend_on_segments(monkeypatch):
    """A long line is searched in parts: each span is found once, wherever the parts meet."""
    rng = random.Random(4)
    line = " ".join(x for _ in range(60) for x in (rng.choice(LINES)[0], "and then some more words follow here to the next one"))
    whole = _found([line])[0]
    monkeypatch.setattr("ledgermill.llm.personal_data.SEGMENT", 997)
    parts = _found([line])[0]
    assert len(whole) >= 50 and sum((Counter(whole) & Counter(parts)).values()) >= 0.97 * max(len(whole), len(parts))


def test_spans_that_overlap_patterns_are_left_out():
    base = [("email", 5, 9), ("card", 20, 40), ("phone", 25, 30)]
    spans = [("id", 0, 5), ("id", 8, 10), ("id", 9, 20), ("id", 35, 50), ("id", 40, 41), ("secret", 0, 60)]
    assert _clear_of(spans, base) == [("id", 0, 5), ("id", 9, 20), ("id", 40, 41)] and _clear_of(spans, []) == spans


def test_very_long_texts_take_bounded_memory():
    """50 MB in one line, and 5 MB without a gap: what the search holds does not grow with the text."""
    model = default_model()
    for text in ("1" * 5_000_000, "a@" + "b." * 2_000_000, "1 2 " * 50_000, "plain words without numbers " * 900_000, "x" * 5_000_000 + " call 555.123.4567 now"):
        tracemalloc.start()
        ((_, every),) = all_spans([text], np.array([True]), model)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6 + 2 * len(text), (text[:20], peak)
    assert [text[a:b] for _, a, b in every] == ["555.123.4567"]


def test_amounts_codes_and_starred_words_are_none():
    lines = ["The house was sold for 1 234 567 EUR last year.", "She was born on 12.04.1987 in the old town.", "The row with the id 3f2b8c1e-7a4d-4e9b-9c31-5d0f6a7b8c9d was deleted.", "He wrote theringha*** twice and left."]
    assert _found(lines) == [[], [], [], []]


def test_prose_has_none(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("NOT text RLIKE '[0-9@]'")
    assert find_personal_data(docs).where("spans <> ''").count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4"), (2, None)], "doc_id bigint, text string")
    assert [r["text"] for r in redact(docs).orderBy("doc_id").collect()] == ["mail <email> or <ip>", ""]


def test_empty_table(no_documents):
    assert find_personal_data(no_documents).count() == 0
