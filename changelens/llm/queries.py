"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import decontamination, language_id, line_dedup, near_dedup, ngram_join, packing, quality_grades, quality_rules, ranked_search, secret_scan, source_divergence, token_store, toxicity
from changelens.llm.sql import BENCHMARK_DECONTAMINATION, NEAR_DEDUP, NGRAM_JACCARD_JOIN, RANKED_SEARCH, SOURCE_DIVERGENCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.checksums(store.documents())


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024)
    return packing.placements(sequences)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc.doc_id", *found.columns[1:])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc.doc_id", "n_lines", "n_removed", "text")


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0: poor, 1: good but toxic, 2: good."""
    rating = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return quality_grades.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rating)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": token_output,
    "op2_ngram_jaccard_join": jaccard_join,
    "op3_packing": packed,
    "op4_secret_scan": secrets,
    "op5_language_id": languages,
    "op6_quality_rules": fertility_rules,
    "op7_line_dedup": lines,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_toxicity": toxic,
    "op10_quality_grades": grades,
    "op11_near_dedup": near_duplicates,
    "op12_source_divergence": divergence,
    "op13_ranked_search": searched,
}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op8_benchmark_decontamination": BENCHMARK_DECONTAMINATION,
    "op11_near_dedup": NEAR_DEDUP,
    "op12_source_divergence": SOURCE_DIVERGENCE,
    "op13_ranked_search": RANKED_SEARCH,
}
