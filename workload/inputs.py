"""Tables shared by several queries, written once per session and scale: in use, the file table, its code
facts and the graphs are tables that later jobs read, not things each query derives anew."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import ranking, reviews
from changelens.operators.chains import FoldedGraph, fold_chains
from changelens.operators.code_facts import FILE, code_facts
from changelens.operators.reach import Ancestry, ancestry, module_reach
from changelens.plans.change_reviews import ChangeReviews
from changelens.plans.review import ImportGraphs, files_of, priority_scores, with_lines_changed
from changelens.sources.review_cache import cache_rows, latest
from changelens.sources.sinks import publish
from changelens.sources.snapshots import pr_file_snapshot
from changelens.storage import new_path, written
from workload import fixtures

SECRET = b"webhook-secret"


class Inputs:
    _made: dict[tuple[str, str], "Inputs"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, object] = {}  # what a stream has written for several queries

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Inputs":
        key = (spark.sparkContext.applicationId, sf_dir)
        return cls._made.setdefault(key, cls(spark, sf_dir))

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def _file_table(self, table: DataFrame, label: str) -> DataFrame:
        # Reading code and answers is heavy per byte: many small files, as a real table has, keep all cores busy.
        return written(table.repartition(self.spark.sparkContext.defaultParallelism * 4, *FILE), label)

    @cached_property
    def source_files(self) -> DataFrame:
        return self._file_table(fixtures.source_files(self.spark, self.sf_dir), "source-files")

    @cached_property
    def responses(self) -> DataFrame:
        return self._file_table(fixtures.model_responses(self.spark, self.sf_dir), "responses")

    def _by_repository(self, table: DataFrame, label: str) -> DataFrame:
        """A table laid out by repository, as streams read it."""
        path = new_path(self.spark, label)
        publish(table, path)
        return self.spark.read.schema(table.schema).parquet(path)

    @cached_property
    def file_events_by_repository(self) -> DataFrame:
        return self._by_repository(self.file_events, "file-events")

    @cached_property
    def files_by_repository(self) -> DataFrame:
        return self._by_repository(self.source_files, "files")

    @cached_property
    def responses_by_repository(self) -> DataFrame:
        return self._by_repository(self.responses, "answers")

    @cached_property
    def file_events(self) -> DataFrame:
        return fixtures.pr_file_events(self.spark, self.sf_dir)

    @cached_property
    def snapshot(self) -> DataFrame:
        return pr_file_snapshot(self.file_events)

    @cached_property
    def parsed(self) -> DataFrame:
        return written(code_facts(self.source_files), "facts")

    @cached_property
    def facts(self) -> DataFrame:
        """All files, with changed lines where the change reported them."""
        return with_lines_changed(self.parsed, self.snapshot)

    @cached_property
    def graphs(self) -> ImportGraphs:
        return ImportGraphs(self.parsed)

    @cached_property
    def packages(self) -> ImportGraphs:
        """Graphs of modules in packages."""
        return ImportGraphs(written(code_facts(fixtures.package_files(self.spark, self.sf_dir)), "package-facts"))

    @cached_property
    def layered_edges(self) -> DataFrame:
        return written(fixtures.layered_edges(self.spark, self.sf_dir), "layered-edges")

    @cached_property
    def layered(self) -> FoldedGraph:
        return fold_chains(self.layered_edges)

    @cached_property
    def layered_ancestry(self) -> Ancestry:
        return ancestry(self.layered)

    @cached_property
    def layered_reach(self) -> DataFrame:
        return written(module_reach(self.layered, self.layered_ancestry), "layered-reach")

    @cached_property
    def chorded(self) -> FoldedGraph:
        return fold_chains(written(fixtures.chorded_edges(self.spark, self.sf_dir), "chorded-edges"))

    @cached_property
    def ladders(self) -> FoldedGraph:
        return fold_chains(written(fixtures.ladder_edges(self.spark, self.sf_dir), "ladder-edges"))

    @cached_property
    def scores(self) -> DataFrame:
        return written(priority_scores(self.facts, self.graphs), "scores")

    @cached_property
    def queue(self) -> DataFrame:
        return written(ranking.review_queue(self.scores), "queue")

    @cached_property
    def snapshot_facts(self) -> DataFrame:
        """Only the files the change snapshot delivers; the others are missing from its graph as well."""
        return written(files_of(self.parsed, self.snapshot), "snapshot-facts")

    @cached_property
    def snapshot_queue(self) -> DataFrame:
        return written(ranking.review_queue(priority_scores(self.snapshot_facts)), "snapshot-queue")

    @cached_property
    def ingested(self) -> DataFrame:
        return written(reviews.ingest(self.responses), "answers")

    @cached_property
    def reviews(self) -> DataFrame:
        return fixtures.reviews(self.spark, self.sf_dir)

    @cached_property
    def issues(self) -> DataFrame:
        return written(fixtures.review_issues(self.spark, self.sf_dir), "issues")

    @cached_property
    def modified_cache(self) -> DataFrame:
        """Cache holding the reviews of all files that were modified (those that gave a review at all)."""
        modified = self.file_events.filter("status = 'modified'").select(*FILE)
        hashes = self.parsed.select(*FILE, "content_hash").join(modified, FILE, "left_semi")
        rows = hashes.join(reviews.reviews(self.ingested), FILE).select(
            "content_hash", reviews.review_json_text().alias("review"),
            F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        )
        return written(latest(rows), "cache")

    @cached_property
    def done(self) -> ChangeReviews:
        """Reviews of the queue of all changes."""
        return ChangeReviews(self.queue, self.modified_cache, self.responses)

    @cached_property
    def document_cache(self) -> DataFrame:
        return latest(cache_rows(fixtures.labelled_entries(self.spark, self.sf_dir)))

    @cached_property
    def document_files(self) -> DataFrame:
        """Every document as the one file of a change."""
        return self.table("documents").select(
            F.concat(F.lit("docs/"), "source").alias("repo"), F.col("doc_id").alias("pr_number"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"),
            F.lit(1).alias("rank"), F.sha2("text", 256).alias("content_hash"), F.length("text").alias("n_chars"),
        )
