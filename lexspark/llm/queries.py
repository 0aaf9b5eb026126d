"""Registered queries of the operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import alignment, ann_tree, filter_audit, html_paths, katz, line_dedup, orc_tokens, packing, parity_join, quality, token_count, unigram_pieces, url_filter
from lexspark.llm.shared import fresh_path

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly_score")


def op2_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_deleted_lines", "n_deleted_words")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)))


def op6_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_tree.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op8_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_main_text(table(spark, sf_dir, "pages"))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    orc_tokens.write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE))
    return orc_tokens.token_digests(spark, path)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_unigram_pieces": op2_unigram_pieces,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_ann_tree": op6_ann_tree,
    "op7_katz_backoff": op7_katz_backoff,
    "op8_html_paths": op8_html_paths,
    "op9_parity_join": op9_parity_join,
    "op10_orc_tokens": op10_orc_tokens,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_filter": op12_url_filter,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op11_filter_audit": filter_audit.SQL}
