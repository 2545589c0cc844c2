"""The queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, language_id, license_scan, line_dedup, line_quality, paragraph_sketch, periodic_runs, piece_transducer, simhash, sort_means, token_records, wrapper_extract
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_records.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = piece_transducer.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids_crc32", "ids", "decoded", "round_trip")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.where(~out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cover")


def op9_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprint_versions(table(spark, sf_dir, "documents"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out("doc_id", 5, 0)
    model = line_quality.learn(docs, labels.where(~out))
    return line_quality.score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted", "good_share")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_loops(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.with_inertia(*sort_means.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_records": op3_token_records,
    "op4_license_scan": op4_license_scan,
    "op5_wrapper_extract": op5_wrapper_extract,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_id": op8_language_id,
    "op9_paragraph_sketch": op9_paragraph_sketch,
    "op10_line_quality": op10_line_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sort_means": op12_sort_means,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op12_sort_means": sort_means.ORACLE, "op13_jaccard_join": jaccard_join.ORACLE}
