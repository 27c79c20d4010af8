"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import decontaminate, html_text, language_id, packing, quality_model, quality_rules, sharding, simhash, substring_dedup, url_filter
from sievelight.llm._common import read_table
from sievelight.llm.sharding import MULTIPLIER, SLOT_BUCKETS
from sievelight.sources.tables import table

#: SQL of op5. The checksum folds over the bytes with the rule of reflected CRC-32;
#: the shard follows the published loop of jump consistent hashing in 128-bit arithmetic.
_OP5 = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key FROM documents
), digits AS (
  SELECT r, doc_id, strlen(body) + 8 AS size, lower(hex(encode(body))) AS x FROM docs
), sums AS (
  SELECT r, doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(x), 2), lambda p: (instr('0123456789abcdef', x[p + 1]) - 1) * 16 + instr('0123456789abcdef', x[p + 2]) - 1)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32
  FROM digits, crc_table
), counts AS (SELECT unnest([24, 25]) AS shards
), jump AS (
  SELECT r, shards, key, -1::BIGINT AS b, 0::BIGINT AS j FROM docs, counts
  UNION ALL
  SELECT r, shards, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT r, shards, b, j, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS k FROM jump WHERE j < shards)
), shard AS (
  SELECT r, max(b) FILTER (WHERE shards = 24) AS shard, max(b) FILTER (WHERE shards = 25) AS grown_shard FROM jump WHERE j >= shards GROUP BY r
), placed AS (
  SELECT s.doc_id, s.size, s.text_crc32, CAST(h.shard AS INTEGER) AS shard, CAST(h.grown_shard AS INTEGER) AS grown_shard,
    (((d.key * {MULTIPLIER} + 1) % 18446744073709551616) // 4294967296) % {SLOT_BUCKETS} AS bucket
  FROM sums s JOIN docs d ON s.r = d.r JOIN shard h ON s.r = h.r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""

#: SQL of op6: every window of 13 words with the smallest document that has it.
_OP6 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS x FROM starts
), lost AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS owner FROM windows) WHERE owner < doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS places FROM lost GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, words, coalesce(places, []) AS places FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
  sha256(coalesce((SELECT string_agg(words[p], ' ' ORDER BY p) FROM (SELECT unnest(range(1, len(words) + 1)) AS p) WHERE NOT list_contains(places, p)), '')) AS kept_sha256
FROM kept
"""


def tokenizer_path() -> str:
    """The vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op1_query(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op2_query(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3_query(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op4_query(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_query(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op6_query(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op7_query(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8_query(table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op9_query(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10_query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction,
        op2_quality_classifier,
        op3_packing,
        op4_url_filter,
        op5_sharding,
        op6_substring_dedup,
        op7_language_id,
        op8_decontamination,
        op9_quality_rules,
        op10_simhash,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; models, tokenizers, compression and XXH64 it can't."""
    return {"op5_sharding": _OP5, "op6_substring_dedup": _OP6}
