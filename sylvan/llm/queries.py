"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lmscore, neardup, packing, quality, rules, secrets, tokens, warc
from .common import read_documents


def _path(name: str) -> str:
    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), _path("byte_bpe_50k.json"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lmscore.score_language(read_documents(spark, sf_dir), labels, _path("byte_bpe_50k.json"), _path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan_secrets(read_documents(spark, sf_dir))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_documents(spark, sf_dir), _path("piece_bpe_32k.model"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_documents(spark, sf_dir), width=2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), read_documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_documents(spark, sf_dir), _path("piece_bpe_32k.model"))


#: DuckDB's equivalent of the WARC query: SHA-1 in hexadecimal, as bits, as base 32.
_OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits,
    min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

_OP9_SQL = """
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', ' ', 'g'), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id
), m AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment FROM m JOIN n ON n.id = m.item_id WHERE 100 * n_shared >= 80 * n_item
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_lm_scoring,
        op4_warc_bundles,
        op5_secret_scans,
        op6_quality_rules,
        op7_minhash_near_dedup,
        op8_language_id,
        op9_benchmark_decontamination,
        op10_token_counts,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_bundles": _OP4_SQL, "op9_benchmark_decontamination": _OP9_SQL}
