import collections
import random
import re

import numpy as np

from ledgermill.llm.quality_rules import CLASSES, COMMON_WORDS, LEVELS, central_references, js_distance, language_references, quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_base_counts(documents, corpus):
    rows = quality_rules(documents, column="q").select("q.*").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[f] for f in fields) for r in rows) == collections.Counter(base(t) for _, t in corpus)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_other_columns_pass(documents):
    out = quality_rules(documents, column="q")
    assert out.columns == [*documents.columns, "q"]
    assert sorted(out.drop("q").collect(), key=repr) == sorted(documents.collect(), key=repr)


def test_junk_goes_and_prose_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").dropDuplicates(["doc_id"])
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    rows = quality_rules(docs, column="q").join(labels, "doc_id").where("NOT q.base_failed").select("q.kept", labels["quality"].alias("label")).collect()
    good = [r["kept"] for r in rows if r["label"] == 1]
    bad = [r["kept"] for r in rows if r["label"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_references_are_sums_over_the_language(documents):
    found = language_references(documents)
    assert set(found) == {"en", "fr"} and set(found) <= set(COMMON_WORDS)
    words = documents.where("lang = 'en'").collect()
    assert sum(found["en"][1]) == sum(base(r["text"])[0] for r in words)


def test_distance():
    p = np.array([[1, 1, 0], [1, 0, 0], [2, 2, 0], [0, 0, 0]])
    q = np.array([[1, 1, 0], [0, 1, 0], [1, 1, 2], [1, 0, 0]])
    assert np.allclose(js_distance(p, q), [0, 1, np.sqrt(0.5 * (np.log2(4 / 3)) + 0.5 * (0.5 * np.log2(2 / 3) + 0.5)), 0])


def test_short_texts_are_not_judged(spark):
    docs = spark.createDataFrame([(1, "|%& " * 20, "en"), (2, "the of and to in a is that for it as was " * 40, "en")], "doc_id bigint, text string, lang string")
    rows = quality_rules(docs).select("doc_id", "quality.class_distance", "quality.word_distance").orderBy("doc_id").collect()
    assert (rows[0]["class_distance"], rows[0]["word_distance"]) == (0.0, 0.0)


def test_empty_table(no_documents):
    assert quality_rules(no_documents).count() == 0


def _prose(rng, n):
    return " ".join(rng.choice(COMMON_WORDS["en"]) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def _junk(rng):
    return " ".join("".join(rng.choice("0123456789#*$%&|<>") for _ in range(6)) for _ in range(400))


def test_a_junk_group_of_a_third_does_not_move_the_reference(spark):
    rng = random.Random(5)
    good = [(i, _prose(rng, rng.randint(500, 700)), "en") for i in range(60)]
    same, junk = _junk(rng), _junk(rng).split()
    groups = {"copies": [same] * 30, "near copies": [" ".join([*junk[:-1], f"#{k}%%{k}"]) for k in range(30)], "failing": ["1|%& 2|%& " * 2000 + str(k) for k in range(30)]}
    for name, texts in groups.items():
        rows = good + [(1000 + k, t, "en") for k, t in enumerate(texts)]
        found = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).select("doc_id", "quality.kept").collect()
        assert {r["doc_id"] for r in found if r["kept"]} == {i for i, _, _ in good}, name


def test_references_are_medians_of_distinct_contents(spark):
    rng = random.Random(6)
    texts = [_prose(rng, rng.randint(10, 80)) for _ in range(20)] + ["too short", "so and so " * 50, None]
    copies = [texts[0]] * 8 + [texts[1].replace(" ", " \n")]
    docs = spark.createDataFrame([(t, "en") for t in texts + copies] + [(texts[2], "xx"), (texts[3], None)], "text string, lang string")
    found = central_references(docs)
    assert set(found) == {"en"}
    passed = [t for t in texts if not base(t)[5]]
    levels = lambda n, total: (2 * LEVELS * n + total) // (2 * total)
    others = sum(len(w) for t in passed for w in t.split() if w not in COMMON_WORDS["en"])
    assert len(passed) == 20 and others and found["en"][0][CLASSES.index("symbol")] == 0
    lower = [[levels(sum(c.islower() for c in t), len(t)) for t in ts] for ts in (passed, [passed[0], copies[-1], *passed[2:]])]
    assert found["en"][0][CLASSES.index("lower")] in [np.median(x) for x in lower]
    words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    for w in ("the", "of", "no"):
        assert found["en"][1][words.index(w)] == np.median([levels(t.split().count(w), len(t.split())) for t in passed])
