"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

Each stage reads what its predecessor wrote as Parquet; its decisions take effect. All stages but the last return the
columns of ``documents``; the last returns the pieces of packed sequences with their token ids.

A null text counts as empty. Documents without a word fail the quality rules, so they go in the first stage; one that loses all
its words to line dedup goes there. Rows without a doc_id pass through all stages; rows that are equal are one text to line
dedup (none loses lines to the other) and one group to the near-duplicate join, of which one row stays. Columns beside doc_id
and text may have any names and values; n_chars is set anew. An empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import line_dedup, packing, parity_join, quality
from lexspark.llm.queries import BYTE_BPE, tokenizer_path
from lexspark.llm.shared import discard, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur earlier are deleted; a document that loses all its words goes."""
    out = line_dedup.dedup_lines(docs).where("n_deleted_words = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of 5-word shingles have a similarity of 0.8 or more, linked directly or through
    others, the one with the smallest doc_id stays."""
    return parity_join.one_of_each(docs, words=5, percent=80)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicate_join),
    ("packing", packed_sequences),
]

#: The isolation forest and the packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
