"""Training data from raw documents, in five stages; each reads what the stage before has written.

A stage takes (spark, docs, sf_dir). The first four return documents with the columns they came with; the last
returns the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changelens.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from changelens.llm.batches import use_small_batches
from changelens.storage import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session of small Arrow batches: most results are made only when they are written, and whole documents
    go to Python there."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return quality_rules.keep(docs, public_tokenizers.path("piece_bpe_32k.model"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier in the corpus, up to a few edits."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids at most, with the pieces of documents in them."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("quality_rules", in_small_batches(quality)),
    ("line_dedup", in_small_batches(lines)),
    ("ngram_jaccard_join", in_small_batches(near_duplicates)),
    ("benchmark_decontamination", in_small_batches(benchmark)),
    ("packing", in_small_batches(packed)),
]

#: The vocabularies' tokens cannot be made in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
