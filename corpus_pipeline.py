"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet and read again. All stages but the
last return the columns of ``documents``, whatever else the table has; the last returns the pieces
of the packed sequences. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from erawood.llm import decontamination, packing, quality, simhash, substring
from erawood.llm.common import discard, scratch_path, stored_at, table

#: No stage but the first can be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and blank texts do."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays; nulls, blanks and repeated rows as in ``simhash.keep_one``."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a smaller doc_id has too are cut out; blanks stay as they are."""
    return substring.keep_unrepeated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and blank texts hold none."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left fills sequences of 2048 tokens, null and blank texts with their end alone."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packed sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is stored in the shared scratch folder until the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i}")
            docs = stored_at(docs, path)
            if before is not None:
                discard(spark, before)
            before = path
    return docs
