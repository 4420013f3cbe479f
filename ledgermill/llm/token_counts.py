"""Token counts by a digest cache: only contents that no earlier run has counted are encoded, once each.

The cache is a Parquet table (tokenizer, d, n_tokens): SHA-256 of the tokenizer's file, SHA-256 of the
content, and its count. Contents are joined to it by both digests; distinct misses are encoded and
appended. A bounded key filter keeps most texts where they are: while most contents are misses, only texts
of repeated or cached digests are shuffled; once most are cached, only texts that may be misses.

The only normalisation that keeps counts exact is null to empty, so that is what the digest covers.

Defined results: a null text is empty and has no tokens; rows that share a content share its count,
whatever their ids; an empty table gives an empty result and leaves the cache alone.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.exact_dedup import with_group
from ledgermill.llm.key_filter import build_filter, may_match
from ledgermill.llm.shared import shared_dir, ship, stage, text_or_empty

CACHE_SCHEMA = "tokenizer string, d binary, n_tokens bigint"
#: Characters encoded by one call of the library.
CALL_CHARS = 100_000
OVER_LIMIT = 1024


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[path] = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    return _loaded[path]


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """d and n_tokens of rows (d, content)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(path)
        for batch in batches:
            counts: list[int] = []
            held: list[str] = []
            size = 0
            for value in batch.column(1):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= CALL_CHARS:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["d", "n_tokens"])

    return rows.select("d", "content").mapInArrow(each, "d binary, n_tokens bigint")


def read_cache(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``cache`` is a Parquet path; without one, a new cache is made."""
    spark = docs.sparkSession
    ship(spark)
    cache = cache or f"{shared_dir(spark)}/token-cache"
    version = tokenizer_digest(tokenizer_path)
    contents = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("content")).withColumn("d", F.unhex(F.sha2("content", 256)))
    digests = stage(contents.select("doc_id", "d", F.octet_length("content").cast("long").alias("n_bytes")))
    groups = stage(digests.groupBy("d").agg(F.count(F.lit(1)).alias("group_rows"), F.min("doc_id").alias("first_id")))
    n_rows, n_digests = groups.agg(F.coalesce(F.sum("group_rows"), F.lit(0)), F.count(F.lit(1))).first()
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("d").agg(F.max("n_tokens").alias("n_tokens"))
    known = stage(groups.join(known, "d").select("d", "n_tokens"))
    misses = groups.join(known, "d", "left_anti")
    n_known = known.count()
    n_misses = n_digests - n_known
    if n_misses:
        wanted = misses.select(F.col("d").alias("miss"), "first_id")
        first_of_miss = (F.col("d") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
        if n_known > n_misses:
            # most contents are counted: only rows that may be misses are met
            few = stage(misses.select("d"))
            met = may_match(contents, "d", build_filter(few, "d"), "may_miss").where("may_miss").join(wanted, first_of_miss)
            missed = met.select("d", "content").dropDuplicates(["d"])
        else:
            # a digest that is neither repeated nor cached is a miss of one row
            special = stage(groups.where("group_rows > 1").select("d").unionByName(known.select("d")))
            marked = may_match(contents, "d", build_filter(special, "d"), "may_repeat")
            alone = marked.where("NOT may_repeat").select("d", "content")
            once = marked.where("may_repeat").join(wanted, first_of_miss).select("d", "content").dropDuplicates(["d"])
            missed = alone.unionByName(once)
        fresh = _counted(missed, tokenizer_path).select(F.lit(version).alias("tokenizer"), "d", "n_tokens")
        fresh.write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("d").agg(F.max("n_tokens").alias("n_tokens"))
    resolved = groups.select("d", "group_rows").join(counts, "d")
    joined = with_group(digests, stage(resolved), "d", n_rows)
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))
