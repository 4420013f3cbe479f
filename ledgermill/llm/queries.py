"""The registered queries of the corpus operators: thin views over them, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgermill.llm.conversation_repair import damage, repair_conversations
from ledgermill.llm.exact_dedup import exact_groups
from ledgermill.llm.filter_audit import filter_audit
from ledgermill.llm.html_extract import extract_main_text
from ledgermill.llm.id_shards import encode_to_shards
from ledgermill.llm.jaccard_join import jaccard_components
from ledgermill.llm.mixing import plan_mix
from ledgermill.llm.personal_data import find_personal_data
from ledgermill.llm.piece_table import piece_digests
from ledgermill.llm.quality_rules import quality_rules
from ledgermill.llm.shared import read_table, ship
from ledgermill.llm.simhash import simhash_components
from ledgermill.llm.token_counts import count_tokens
from ledgermill.llm.warc import deduplicate_pages


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    return quality_rules(docs).select("doc_id", *(f"quality.{f}" for f in fields))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op8_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_pages(read_table(spark, sf_dir, "pages")).drop("url")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(read_table(spark, sf_dir, "conversations")))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_distribution_divergence,
    op2_personal_data,
    op3_exact_dedup,
    op4_curriculum_mix,
    op5_jaccard_join,
    op6_token_counts,
    op7_html_extraction,
    op8_id_shards,
    op9_sentencepiece,
    op10_warc_revisits,
    op11_conversation_repair,
    op12_simhash_trie,
    op13_filter_audit,
)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for q in _OPERATORS}


_WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": r"""
            WITH contents AS (
                SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
            ), grouped AS (
                SELECT doc_id, content,
                       min(doc_id) OVER (PARTITION BY content) AS keep_id,
                       count(*) OVER (PARTITION BY content) AS group_size,
                       row_number() OVER (PARTITION BY content ORDER BY doc_id) AS place
                FROM contents
            )
            SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(content) AS text_sha256
            FROM grouped""",
        "op4_curriculum_mix": f"""
            WITH sized AS (
                SELECT doc_id, source, {_WORDS} AS size, md5(coalesce(text, '')) AS digest FROM documents
            ), hashed AS (
                SELECT *, substr(md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), digest)), 1, 12) AS h FROM sized
            ), sources AS (
                SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
                FROM sized GROUP BY source
            ), weighed AS (
                SELECT *, [3.0::DOUBLE, 1.0, 2.0][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS stop FROM sources
            ), levelled AS (
                SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                           - coalesce(sum(stop) OVER (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                          / sum(weight) OVER (ORDER BY stop / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
                FROM weighed
            ), targets AS (
                SELECT source, place, source_size,
                       least(stop, coalesce(max(CASE WHEN level * weight <= stop THEN level END) OVER () * weight, stop)) AS target
                FROM levelled
            ), placed AS (
                SELECT doc_id, size, source_size, target, place,
                       CAST(coalesce(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id NULLS LAST, size
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
                FROM hashed JOIN targets ON hashed.source IS NOT DISTINCT FROM targets.source
            ), counted AS (
                SELECT *, CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END
                        + CASE WHEN size > 0 AND source_size + before + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END AS copies,
                       [1.5::DOUBLE, 1.0, 0.5][place % 3 + 1] AS c0, [0.5::DOUBLE, 1.0, 1.5][place % 3 + 1] AS c1
                FROM placed
            ), timed AS (
                SELECT *, before / target * (c0 + c1) / 2 AS area FROM counted
            )
            SELECT doc_id, size, source_size, target, copies * size AS taken, CAST(copies AS BIGINT) AS copies,
                   CASE WHEN copies > 0 THEN
                       least(1.0::DOUBLE, 2 * area / (c0 + sqrt(greatest(0.0::DOUBLE, c0 * c0 + 2 * (c1 - c0) * area))))
                   END AS position
            FROM timed""",
        "op13_filter_audit": r"""
            WITH texts AS (
                SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                       regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
                FROM documents
            ), judged AS (
                SELECT doc_id, part,
                       [len(words) < 100,
                        100 * len(list_distinct(words)) < 80 * len(words),
                        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
                        regexp_matches(text, '[#$%&*|]'),
                        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
                FROM texts
            ), known AS (
                SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
            ), cells AS (
                SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
                FROM judged LEFT JOIN known USING (doc_id) GROUP BY part, fails
            ), letters AS (
                SELECT unnest([1, 2, 3, 4, 5]) AS f
            ), orders AS (
                SELECT [a.f, b.f, c.f, d.f, e.f] AS steps
                FROM letters a, letters b, letters c, letters d, letters e
                WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
            ), steps AS (
                SELECT steps, step, steps[step] AS f, steps[1 : step - 1] AS before FROM orders, (SELECT f AS step FROM letters)
            ), told AS (
                SELECT part, f, step,
                       array_to_string(list_transform(steps, lambda x: 'ABCDE'[x]), '') AS filter_order,
                       CAST(sum(CASE WHEN NOT earlier AND NOT fails[f] THEN n ELSE 0 END) AS BIGINT) AS kept,
                       CAST(sum(CASE WHEN NOT earlier AND fails[f] THEN n ELSE 0 END) AS BIGINT) AS removed,
                       CAST(sum(CASE WHEN earlier AND fails[f] THEN n ELSE 0 END) AS BIGINT) AS redundant,
                       CAST(sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                       CAST(sum(CASE WHEN NOT earlier AND fails[f] THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
                       CAST(sum(CASE WHEN NOT earlier AND fails[f] THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost
                FROM (SELECT *, coalesce(list_bool_or(list_transform(before, lambda x: fails[x])), false) AS earlier FROM cells, steps)
                GROUP BY part, steps, f, step
            )
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
                   CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
            FROM told""",
    }

