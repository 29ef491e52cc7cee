"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import read_table, ship_package
from . import lexical_search, license_scan, media, mixing, ngram_join, order_minhash, piece_codec, pii, quality, substring_dedup, token_align, vector_join, warc

Query = Callable[[SparkSession, str], DataFrame]


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), newest AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p
), marked AS (
  SELECT *, CASE WHEN newest IS NOT NULL AND (page_id IS NULL OR page_id < newest) THEN newest END AS refers_to FROM newest
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM marked
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup.remove_repeats(spark, read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_codec.encode_column(read_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.similar_components(spark, read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return warc.page_records(spark, read_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return media.store_text(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return order_minhash.edited_neighbours(spark, read_table(spark, sf_dir, "documents"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return lexical_search.rank_documents(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_align.align_tokens(spark, read_table(spark, sf_dir, "documents"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vector_join.similar_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_ngram_join": op3_ngram_join,
        "op4_mixing": op4_mixing,
        "op5_warc": op5_warc,
        "op6_quality": op6_quality,
        "op7_licenses": op7_licenses,
        "op8_media": op8_media,
        "op9_pii": op9_pii,
        "op10_fingerprints": op10_fingerprints,
        "op11_search": op11_search,
        "op12_alignment": op12_alignment,
        "op13_vectors": op13_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.DEDUP_SQL,
        "op3_ngram_join": ngram_join.JOIN_SQL,
        "op4_mixing": mixing.MIX_SQL,
        "op5_warc": WARC_SQL,
        "op11_search": lexical_search.SEARCH_SQL,
        "op13_vectors": vector_join.VECTOR_SQL,
    }
