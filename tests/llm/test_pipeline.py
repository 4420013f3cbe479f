import hashlib
import random
from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from test_mixing import targets

from ledgermill.llm.quality_rules import quality_rules
from ledgermill.llm.shared import stage


def test_stages(documents):
    docs = stage(documents)
    counts = [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(documents.sparkSession, docs, ""))
        assert out.columns == documents.columns
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    assert corpus_pipeline.STAGES[-1][1](documents.sparkSession, docs, "").count() == counts[-1]


def test_against_brute_force(spark, corpus):
    """Every stage, row by row: odd texts, ids on several texts, sources on several ids, null ids and full repeats included."""
    rng = random.Random(8)
    langs, sources = ("en", "fr", "xx", None), ("src1", "src0", None, "é")
    rows = [(i, t, langs[k % 4], sources[k % 3]) for k, (i, t) in enumerate(corpus)]
    prose = [r for r in rows if r[1] and 60 < len(r[1].split()) < 400][:60]
    for k, (_, text, lang, source) in enumerate(prose):
        words = text.split()
        edited = list(words)
        edited[rng.randrange(len(edited))] = "other"
        rows.append((9000 + k, " ".join(edited), lang, source))
        rows.append((7, " ".join(words[k % 7 :]), lang, sources[k % 4]))
        rows.append((None, " ".join(words[: -1 - k % 5]), lang, sources[(k + 1) % 4]))
        rows.append((9500 + k, " ".join(reversed(words)), lang, sources[k % 4]))
    rows += rows[-40:]
    docs = stage(spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    read = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    plain = lambda found: Counter((r[0], r[1], r[3]) for r in found)
    steps = dict(corpus_pipeline.STAGES)

    verdicts = brute.quality(rows)
    close = [r for r, v in zip(rows, verdicts) if abs(v[1] - 0.25) < 1e-9 or abs(v[2] - 0.31) < 1e-9]
    assert not close
    kept = [r for r, v in zip(rows, verdicts) if v[0]]
    docs = stage(steps["quality rules"](spark, docs, ""))
    assert read(docs) == plain(kept) and len(kept) > 100

    docs = stage(steps["exact dedup"](spark, docs, ""))
    normal = lambda found: Counter((r[0], " ".join((r[1] or "").split(" "))) for r in found)
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == normal(brute.exact(kept))

    left = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    docs = stage(steps["n-gram Jaccard join"](spark, docs, ""))
    assert read(docs) == plain(brute.near(left)) and docs.count() < len(left)

    left = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    docs = stage(steps["mixing sources"](spark, docs, ""))
    mixed = brute.mix(left, targets)
    assert read(docs) == plain(mixed) and len(mixed) > len(left)

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = Counter((r[0], len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))) for r in mixed for ids in [model.encode(r[1])])
    assert Counter(tuple(r) for r in steps["SentencePiece"](spark, docs, "").collect()) == want


def test_quality_distances_against_brute_force(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
    found = quality_rules(documents.select("doc_id", "text", "lang", "source")).select("doc_id", "text", "lang", "quality.kept", "quality.class_distance", "quality.word_distance").collect()
    key = lambda i, t, lang: (repr(i), t or "", lang or "")
    want = sorted((key(*r[:3]), *v) for r, v in zip(rows, brute.quality(rows)))
    got = sorted((key(r["doc_id"], r["text"], r["lang"]), r["kept"], r["class_distance"], r["word_distance"]) for r in found)
    assert [(k, kept) for k, kept, *_ in got] == [(k, kept) for k, kept, *_ in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[2:], w[2:]))


def test_stages_on_no_rows(no_documents):
    docs = stage(no_documents)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(no_documents.sparkSession, docs, ""))
        assert docs.count() == 0


def test_whole_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_registered_queries():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
