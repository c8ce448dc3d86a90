"""Which queued files still need a review, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.operators.code_facts import FILE
from changelens.operators.reviews import read_reviews, valid_reviews
from changelens.skew import hot_keys, salted_join
from changelens.storage import written

HASH = ["content_hash"]


def _hot_hashes(rows: DataFrame) -> DataFrame:
    return hot_keys(rows.groupBy(*HASH).agg(F.count("*").alias("n")), HASH)


def cache_lookup(rows: DataFrame, cache: DataFrame, spread_by: str = "filename") -> DataFrame:
    """``rows`` with the cached review of their content, NULL where there is none. ``cache`` has one entry
    per hash; the rows may hold very many copies of one text."""
    return salted_join(rows, cache.select(*HASH, "review"), HASH, "left", _hot_hashes(rows), F.col(spread_by))


def cache_split(queue: DataFrame, cache: DataFrame) -> DataFrame:
    """Is a queued file already in the cache? Decided before any review is run."""
    found = cache_lookup(queue, cache)
    return found.withColumn("is_cached", F.col("review").isNotNull()).drop("review")


def review_plan(queue: DataFrame, cache: DataFrame) -> DataFrame:
    """What to do with every queued file when changes are worked through in (repo, number, rank) order.

    ``cached``: a valid cached review exists. ``review``: first file of the run with this content.
    ``reuse``: takes over the review of that first file (columns ``from_*``). A cached value that does not
    meet the review schema is ignored.
    """
    # Only the entries some queued file asks for are checked.
    asked = cache.join(queue.select(*HASH).distinct(), HASH, "left_semi")
    known = cache_lookup(queue, valid_reviews(asked, "review").select(*HASH, F.lit(True).alias("review")))
    looked_up = written(known, "looked-up")  # read three times; the cached values are checked once
    missing = looked_up.filter("review IS NULL").drop("review")
    me = F.struct(*KEY, "rank", "filename")
    # The first file of each content by a partial aggregation, never by sorting a group of copies.
    groups = missing.groupBy(*HASH).agg(F.min(me).alias("first"), F.count("*").alias("n"))
    planned = salted_join(missing, groups.drop("n"), HASH, "left", hot_keys(groups, HASH), F.col("filename"))
    hits = looked_up.filter("review IS NOT NULL").drop("review").select(
        *queue.columns, F.lit("cached").alias("action"),
        F.lit(None).cast("string").alias("from_repo"), F.lit(None).cast("long").alias("from_pr_number"),
        F.lit(None).cast("string").alias("from_filename"),
    )
    misses = planned.select(
        *queue.columns, F.when(me == F.col("first"), "review").otherwise("reuse").alias("action"),
        F.col("first.repo").alias("from_repo"), F.col("first.pr_number").alias("from_pr_number"),
        F.col("first.filename").alias("from_filename"),
    )
    return hits.unionByName(misses)


def _in_order(plan: DataFrame) -> DataFrame:
    """Planned files without a cached review, with their place in the order of work."""
    return plan.filter("action <> 'cached'").select(
        *FILE, "rank", "content_hash", "action", F.struct(*KEY, "rank", "filename").alias("_me")
    )


def first_reviews(plan: DataFrame, reviews: DataFrame) -> DataFrame:
    """Of each content the first planned file that got a review, and that review."""
    todo = _in_order(plan)
    columns = [c for c in reviews.columns if c not in FILE]
    answered = todo.join(reviews.select(*FILE, F.struct(*columns).alias("_review")), FILE)
    return answered.groupBy(*HASH).agg(F.min("_me").alias("_first"), F.min_by("_review", "_me").alias("_review"))


def taken_over(plan: DataFrame, first: DataFrame) -> DataFrame:
    """:func:`first_reviews` given to their files and to all later files of the same content."""
    todo = _in_order(plan)
    taken = salted_join(todo, first, HASH, "inner", _hot_hashes(todo), F.col("filename"))
    return taken.filter(F.col("_me") >= F.col("_first")).select(*FILE, "rank", "content_hash", "action", "_review.*")


def planned_reviews(plan: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of all planned files once answers are in: the first file of each content that got a review keeps it,
    and all later files of that content take it over. Files before it, whose answers were no review, are left out."""
    return taken_over(plan, first_reviews(plan, reviews))


def cached_reviews(plan: DataFrame, cache: DataFrame) -> DataFrame:
    """Reviews of the planned files whose content is in the cache, in the columns of :func:`taken_over`."""
    hits = plan.filter("action = 'cached'").select(*FILE, "rank", "content_hash", "action")
    asked = cache.join(hits.select(*HASH).distinct(), HASH, "left_semi")
    return salted_join(hits, read_reviews(asked, "review", HASH), HASH, "inner", _hot_hashes(hits), F.col("filename"))


def refused(plan: DataFrame, ingested: DataFrame) -> DataFrame:
    """Answers that were no review, of the files that were asked: those before the first review of their content."""
    answered = _in_order(plan).join(ingested.select(*FILE, "error_kind", "error_detail"), FILE)
    none = F.col("error_kind") == "not_object"
    first = answered.filter(~none).groupBy(*HASH).agg(F.min("_me").alias("_first"))
    bad = answered.filter(none)
    placed = salted_join(bad, first, HASH, "left", _hot_hashes(bad), F.col("filename"))
    asked = F.col("_first").isNull() | (F.col("_me") < F.col("_first"))
    return placed.filter(asked).select(*FILE, "error_kind", "error_detail")


def retries(plan: DataFrame, ingested: DataFrame) -> DataFrame:
    """Files to ask for next: of each content all of whose answers so far were no review, the next file in the order
    of work. Their answers join the others, until nothing is left to ask."""
    todo = _in_order(plan)
    none = F.col("error_kind") == "not_object"
    asked = todo.join(ingested.select(*FILE, "error_kind"), FILE).groupBy(*HASH).agg(
        F.max("_me").alias("_last"), F.every(none).alias("_none")
    ).filter("_none")
    later = salted_join(todo, asked, HASH, "inner", _hot_hashes(todo), F.col("filename"))
    following = later.filter(F.col("_me") > F.col("_last")).groupBy(*HASH).agg(F.min("_me").alias("_me"))
    return following.select("_me.*", "content_hash")
