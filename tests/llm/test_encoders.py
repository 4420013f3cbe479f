import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgermill.llm.id_shards import PerfectHash, WordTable, build_index, encode_to_shards, lookup, read_ids, shard_table, write_shards
from ledgermill.llm.piece_table import PieceTable, _requests, _segmented, build_table, encode_documents, piece_digests
from ledgermill.llm.shared import stage
from ledgermill.llm.token_counts import count_tokens, read_cache

BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def _odd_texts(n):
    rng = random.Random(4)
    parts = [*"ab é漢🙂\n\t\r ▁  \x00İ²'s!,.<|>Éßǅ0́  ", "'ll", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<0x41>", "▁▁", "\n\n", " \n", "the", "ing", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_piece_table_equals_the_library():
    table, library = PieceTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = _odd_texts(6000)
    for text, (n, joined, decoded) in zip(texts, table.encode(texts)):
        ids = library.encode(text)
        assert (n, joined.decode(), decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), text


def test_piece_digests(documents, corpus):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = collections.Counter()
    for i, t in corpus:
        ids = library.encode(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert collections.Counter(tuple(r) for r in piece_digests(documents, PIECES).collect()) == want
    row = encode_documents(documents.where("doc_id = 6003"), PIECES).first()
    assert (row["ids"], row["decoded"]) == (library.encode("one"), "one")


def test_pieces_by_blocks(spark):
    """Many blocks, odd texts and chunks that blocks ask for again and again: as the library has it."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = _odd_texts(3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: r for r in encode_documents(docs, PIECES, block_chars=2000).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text)
        assert (rows[i]["ids"], rows[i]["decoded"]) == (ids, library.decode(ids)), text


def test_a_chunk_is_segmented_once(spark, tmp_path):
    """Requests of a chunk come to one task: replies cover every block, and each is read from its file."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words "), (F.col("id") % 7).cast("string")).alias("text")).repartition(8)
    folder = f"file://{tmp_path}/pieces"
    blocks = build_table(docs, PIECES, folder, block_chars=200).collect()
    assert len(blocks) >= 8 and len(list((tmp_path / "pieces").glob("block-*"))) == len(blocks)
    assert all(4 <= r["n_chunks"] <= 10 for r in blocks)


def test_more_chunks_than_a_table_holds(monkeypatch):
    """Requests of all parts together ask for far more chunks than a table holds, a part for fewer: each is segmented once, for whatever block asks."""
    monkeypatch.setattr("ledgermill.llm.piece_table.TABLE_ENTRIES", 100)
    table, segmented = PieceTable(PIECES), collections.Counter()
    segment = table._segment
    table._segment = lambda chunks: segmented.update(chunks) or segment(chunks)
    rng = random.Random(8)
    texts = [" ".join(f"word{rng.randint(0, 999)}" for _ in range(300)) for _ in range(12)]
    requests = sorted((part, block, "\0".join(chunks).encode()) for block, text in enumerate(texts) for part, chunks in _requests(table, [text], 40).items())
    batches = [pa.RecordBatch.from_pylist([dict(zip(("part", "block", "chunks"), r)) for r in requests[lo : lo + 7]]) for lo in range(0, len(requests), 7)]
    replies = [r for batch in _segmented(iter(batches), table) for r in batch.to_pylist()]
    assert [(r["part"], r["block"]) for r in replies] == [r[:2] for r in requests]
    assert len(segmented) > 800 and set(segmented.values()) == {1}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {c: ids for r, (*_, raw) in zip(replies, requests) for c, ids in zip(raw.decode().split("\0"), r["ids"].decode().split(";"))}
    assert all(",".join(map(str, library.encode(c.lstrip("▁")))) == ids for c, ids in found.items())


def test_texts_that_differ_at_the_second_reading(spark):
    """Replies for other texts are not used: the task segments what it reads."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.uuid(), F.lit("word"), F.uuid()).alias("text"))
    for r in encode_documents(docs, PIECES, block_chars=1500).collect():
        assert library.encode(r["decoded"]) == r["ids"]


def test_word_table_equals_the_library():
    table, library = WordTable(WORDS), Tokenizer.from_file(WORDS)
    assert table.by_words and table.width == 2
    texts = _odd_texts(4000) + ["one's '' !'s ''s 12's x'll  ß"]
    for text, raw in zip(texts, table.encode(texts)):
        assert np.frombuffer(raw, dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
    other = WordTable(BYTES)
    assert not other.by_words and np.frombuffer(other.encode(["a b"])[0], dtype="<u2").tolist() == Tokenizer.from_file(BYTES).encode("a b").ids


def test_every_letter_equals_the_libraries():
    """Lower-casing can leave the range of letters that the word table takes apart (Ɔ to ɔ)."""
    words, pieces = WordTable(WORDS), PieceTable(PIECES)
    library, model = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for c in map(chr, range(1, 0x2200)) for t in (f"w{c}'s", f"1{c}{c} ")]
    for text, raw, (_, joined, _) in zip(texts, words.encode(texts), pieces.encode(texts)):
        assert np.frombuffer(raw, dtype="<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert joined.decode() == ",".join(map(str, model.encode(text))), text


def test_shards(documents, corpus):
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    rows = encode_to_shards(documents, WORDS, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_an_id_in_many_shards(spark):
    """Rows of one doc_id, and rows without one, are dealt to many shards; their numbers go on from shard to shard, and every row is found again."""
    texts = [f"{hashlib.md5(str(i).encode()).hexdigest()} text" for i in range(900)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges are else one shard
    try:
        found = encode_to_shards(docs, WORDS, 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: r[1]) == want
    for i in (None, 7):
        per_shard = collections.Counter(r["shard"] for r in found if r["doc_id"] == i)
        assert len(per_shard) >= 2 and max(per_shard.values()) <= 250


def test_index(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/ids"
    table = stage(shard_table(stage(write_shards(documents, WORDS, 2, folder)), folder))
    built = stage(build_index(table, folder, 5))
    assert built.agg(F.sum("n_keys")).first()[0] == documents.count()
    assert sorted(lookup(table.select("doc_id", "number"), folder, 5, built).collect()) == sorted(table.collect())
    foreign = spark.range(10**9, 10**9 + 500).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("number"))
    assert lookup(foreign, folder, 5, built).where("shard IS NOT NULL").count() == 0
    assert lookup(foreign, f"{folder}/none", 5, built.where("false")).where("shard IS NULL").count() == 500
    with pytest.raises(Exception, match="no place for a document"):
        read_ids(lookup(foreign, folder, 5, built), folder, 3).collect()
    (tmp_path / "ids" / "index-000002.mph").unlink()
    with pytest.raises(Exception, match="index-000002"):
        lookup(table.select("doc_id", "number"), folder, 5, built).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    index, _ = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys).tolist()) == list(range(n))


def test_token_counts(documents, corpus, tmp_path):
    library, cache = Tokenizer.from_file(BYTES), f"file://{tmp_path}/cache"
    want = collections.Counter()
    for i, t in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    contents = len({t or "" for _, t in corpus})
    for _ in range(2):
        assert collections.Counter(tuple(r) for r in count_tokens(documents, BYTES, cache).collect()) == want
        assert read_cache(documents.sparkSession, cache).count() == contents
    more = documents.select("doc_id", "text").union(documents.sparkSession.createDataFrame([(1, "new one"), (2, "new one"), (3, "newer")], "doc_id bigint, text string"))
    assert count_tokens(more, BYTES, cache).count() == len(corpus) + 3
    assert read_cache(documents.sparkSession, cache).count() == contents + 2
    count_tokens(documents, PIECES, cache).count()
    assert read_cache(documents.sparkSession, cache).select("tokenizer").distinct().count() == 2


def test_special_strings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id bigint, text string")
    assert count_tokens(docs, BYTES).first()["n_tokens"] == 3


def test_empty_tables(no_documents):
    assert piece_digests(no_documents, PIECES).count() == 0
    assert encode_to_shards(no_documents, WORDS, 2).count() == 0
    assert count_tokens(no_documents, BYTES).count() == 0
