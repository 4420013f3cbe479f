"""A training-data pipeline over ``documents``: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which it gets as
a Parquet table read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm.exact_dedup import drop_copies
from ledgermill.llm.jaccard_join import drop_near_copies
from ledgermill.llm.mixing import mix_documents
from ledgermill.llm.piece_table import piece_digests
from ledgermill.llm.quality_rules import quality_rules
from ledgermill.llm.shared import free_name, read_table, scratch, shared_dir, ship, stage


#: Characters in a block of op9's table: fewer than by default, since executors still hold what earlier stages took; each
#: block then asks for more of the chunks that others ask for too, which costs shuffle.
BLOCK_CHARS = 2_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    verdict = free_name(docs, "quality")
    return quality_rules(docs, column=verdict).where(f"{verdict}.kept").drop(verdict)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content."""
    return drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of similar documents."""
    ship(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    ship(spark)
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), block_chars=BLOCK_CHARS)


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_similar),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Histogram references, similarity components and segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        folder = shared_dir(spark)
        with scratch(spark):  # what a stage writes on its way goes when its result is there
            docs = stage(step(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)
