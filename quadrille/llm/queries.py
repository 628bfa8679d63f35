"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import balltree, bottomk, decontamination, filter_audit, language, media, oracle, packing, pii, secret_scan, similarity, substrings, token_counts, token_files
from quadrille.llm.spans import digests
from quadrille.llm.storage import materialize, read_table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.encode_documents(read_table(spark, sf_dir, "documents")), "op1-media")
    return media.stored_digests(stored)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.fold(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    prototypes = language.learn(docs.where("not held_out"))
    found = language.identify(docs.select("doc_id", "text", "held_out"), prototypes)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenized_pieces(read_table(spark, sf_dir, "documents")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read_table(spark, sf_dir, "documents"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("k")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")), pii.KINDS)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(secret_scan.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")), secret_scan.KINDS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.length_histogram(read_table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_language_id, op3_best_fit_packing, op4_ngram_jaccard_join, op5_substring_dedup, op6_token_id_files, op7_benchmark_decontamination, op8_pii, op9_secret_scans, op10_token_counts, op11_lexical_search, op12_filter_audit, op13_bottomk_dedup)}


def oracle_sql() -> dict[str, str]:
    """Trained models, token ids and media have none; they are tested against brute force."""
    return dict(oracle.SQL)
