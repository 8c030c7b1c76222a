"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import byte_bpe, digest, langid, oracles, packing, pii, piece_bpe, quality, simhash, spelling, tiff, toxicity, turns, warc
from causeway.llm.common import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.document_media(table(spark, sf_dir, "documents"))


def op4_dictionary_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placements(table(spark, sf_dir, "documents"))


def op9_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.audit(rows, turns.damage(rows))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_factorisation_quality": op2_factorisation_quality,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_dictionary_toxicity": op4_dictionary_toxicity,
    "op5_piece_language": op5_piece_language,
    "op6_weak_supervision_pii": op6_weak_supervision_pii,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op9_canonical_digest": op9_canonical_digest,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_turn_repair": op11_turn_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_forced_boundary_bpe": op13_forced_boundary_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op11_turn_repair": oracles.TURNS,
    "op12_spelling_variants": oracles.SPELLING,
    "op1_warc_revisits": """
        WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
        h AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS hexed FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY hexed, payload_bytes) AS original FROM h),
        b AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (('0x' || substr(hexed, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4)::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest FROM m)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> original THEN original END AS refers_to FROM b
    """,
}
