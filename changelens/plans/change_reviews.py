"""From queue, cache and model answers to the reviews of all changes and what is published about them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.operators import cached_work, comments, reviews
from changelens.operators.code_facts import FILE
from changelens.plans.review import error_log
from changelens.storage import written


@dataclass
class ChangeReviews:
    """Reviews of the queued files ``(FILE, rank, content_hash, n_chars, ...)`` of all changes.

    A file's review comes from the cache, from its own answer, from an earlier file with the same content, or says
    that the file is too long. ``answers`` may hold answers for any files; only those of files that had to be asked
    count. Each part is written once, when first needed.
    """

    queue: DataFrame
    cache: DataFrame
    answers: DataFrame

    @cached_property
    def plan(self) -> DataFrame:
        return written(cached_work.review_plan(self.queue, self.cache), "plan")

    @cached_property
    def ingested(self) -> DataFrame:
        """Answers for files that are neither cached nor too long."""
        open_files = self.plan.filter((F.col("action") != "cached") & ~reviews.oversize(F.col("n_chars")))
        return written(reviews.ingest(self.answers.join(open_files.select(*FILE), FILE, "left_semi")), "answers")

    @cached_property
    def _first(self) -> DataFrame:
        todo = self.plan.filter("action <> 'cached'")
        new = reviews.reviews(self.ingested).unionByName(reviews.oversize_reviews(todo))
        return written(cached_work.first_reviews(self.plan, new), "first-reviews")

    @cached_property
    def reviews(self) -> DataFrame:
        """``(FILE, rank, content_hash, action, error_kind, reported_filename, summary, overall_score, issues)``; files
        whose answers all were no review, or have not come yet, are missing."""
        cached = cached_work.cached_reviews(self.plan, self.cache)
        return written(cached.unionByName(cached_work.taken_over(self.plan, self._first)), "reviews")

    @cached_property
    def issues(self) -> DataFrame:
        return reviews.issues(self.reviews)

    @property
    def cache_entries(self) -> DataFrame:
        """What this run adds to the cache, one entry a content."""
        return self._first.select(
            "content_hash", *[F.col(f"_review.{c}").alias(c) for c in ("reported_filename", "issues", "summary", "overall_score")]
        ).select("content_hash", reviews.review_json_text().alias("review"))

    def requests(self, facts: DataFrame, files: DataFrame) -> DataFrame:
        return reviews.review_requests(self.plan, facts, files)

    def retries(self) -> DataFrame:
        return cached_work.retries(self.plan, self.ingested)

    def comments(self) -> DataFrame:
        return comments.inline_comments(self.issues)

    def summaries(self) -> DataFrame:
        return comments.pr_summaries(self.queue, self.reviews, self.issues)

    def totals(self) -> DataFrame:
        return reviews.issue_totals(self.reviews, self.issues)

    def errors(self, facts: DataFrame, posting_errors: DataFrame | None = None) -> DataFrame:
        """The error log of all steps. ``posting_errors(key, message)`` count for changes that had a review to post."""
        if posting_errors is not None:
            posting_errors = posting_errors.join(self.reviews.select(*KEY).distinct(), KEY, "left_semi")
        return error_log(facts, cached_work.refused(self.plan, self.ingested), posting_errors)
