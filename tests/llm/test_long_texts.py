"""Every operator over texts of three million characters, their copies and near copies."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgermill.llm.exact_dedup import exact_groups
from ledgermill.llm.id_shards import encode_to_shards
from ledgermill.llm.jaccard_join import jaccard_components
from ledgermill.llm.mixing import mix_documents, plan_mix
from ledgermill.llm.personal_data import find_personal_data
from ledgermill.llm.piece_table import piece_digests
from ledgermill.llm.quality_rules import quality_rules
from ledgermill.llm.token_counts import count_tokens
from ledgermill.llm.warc import deduplicate_pages

LONG = " ".join(f"word{i % 90_000} and" for i in range(250_000))
TEXTS = {1: LONG, 2: LONG, 3: LONG + " one more", 4: "x" * 3_000_000, 5: "short text"}


@pytest.fixture(scope="module")
def long_documents(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in TEXTS.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2)


def _by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_counts_and_groups(long_documents):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in TEXTS.items()}
    assert {i: r["quality"]["n_words"] for i, r in _by_id(quality_rules(long_documents)).items()} == words
    assert {i: r["keep_id"] for i, r in _by_id(exact_groups(long_documents)).items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {i: r["size"] for i, r in _by_id(plan_mix(long_documents)).items()} == words
    assert set(r["doc_id"] for r in mix_documents(long_documents).select("doc_id").collect()) <= set(TEXTS)
    assert {i: r["component_id"] for i, r in _by_id(jaccard_components(long_documents)).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {i: r["spans"] for i, r in _by_id(find_personal_data(long_documents.where("doc_id > 3"))).items()} == {4: "", 5: ""}


def test_encoders(long_documents):
    docs, texts = long_documents.where("doc_id IN (1, 2, 5)"), {i: TEXTS[i] for i in (1, 2, 5)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: r["n_tokens"] for i, r in _by_id(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))).items()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sums = {i: zlib.crc32(np.array([*words.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t in texts.items()}
    assert {i: r["ids_crc32"] for i, r in _by_id(encode_to_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 2)).items()} == sums
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shas = {i: hashlib.sha256(",".join(map(str, pieces.encode(t))).encode()).hexdigest() for i, t in texts.items()}
    assert {i: r["ids_sha256"] for i, r in _by_id(piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))).items()} == shas


def test_archives(spark):
    pages = spark.createDataFrame([(1, "a", LONG), (2, "b", LONG), (3, "c", "y" * 3_000_000)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in deduplicate_pages(pages).collect()}
    assert rows == {1: (len(LONG), "response"), 2: (len(LONG), "revisit"), 3: (3_000_000, "response")}
