"""Risk ranking of the files of every change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens import KEY
from changelens.functions.names import ranking_name
from changelens.functions.scoring import risk_score
from changelens.operators.code_facts import FILE, max_complexity
from changelens.operators.reach import impact_counts


def priority_scores(facts: DataFrame, reach: DataFrame) -> DataFrame:
    """Score of every valid file. ``facts.lines_changed`` is NULL for a file without a change entry, which
    then counts with all its lines; an entry of 0 stays 0."""
    files = facts.filter("error_kind IS NULL").select(
        *FILE, "content_hash", "n_chars",
        ranking_name(F.col("filename")).alias("ranking_name"),
        max_complexity().alias("complexity"),
        F.coalesce("lines_changed", "total_lines").cast("long").alias("lines_changed"),
    )
    ranked = impact_counts(files, reach).withColumnRenamed("impact", "dependencies").drop("ranking_name")
    score = risk_score(F.col("complexity"), F.col("dependencies"), F.col("lines_changed"))
    return ranked.withColumn("score", score)


def _by_risk() -> W:
    return W.partitionBy(*KEY).orderBy(F.desc("score"), "filename")


def review_queue(scores: DataFrame, max_files: int = 5) -> DataFrame:
    """The ``max_files`` riskiest files of every change, ties by file name. Spark cuts every map task's
    share to ``max_files`` rows per change before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(_by_risk())).filter(F.col("rank") <= max_files)


def queue_next(scores: DataFrame) -> DataFrame:
    """The file each change takes up next."""
    return review_queue(scores, 1).drop("rank")


def queue_rest(scores: DataFrame) -> DataFrame:
    """What remains after the next file is taken."""
    return scores.join(queue_next(scores).select(*FILE), FILE, "left_anti")


def queue_size(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*KEY).agg(F.count("*").alias("size"))
