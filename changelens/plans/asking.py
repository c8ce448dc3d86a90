"""Ask for reviews until nothing is left to ask."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators import cached_work, reviews
from changelens.operators.code_facts import FILE
from changelens.storage import written, written_counting


@dataclass
class Asked:
    """``asked(FILE, content_hash, round)``: every file that was asked for; ``answers``: what came back, read, with the
    ``round``; ``reviews``: of all planned files with a review, their own or that of an earlier file."""

    asked: DataFrame
    answers: DataFrame
    reviews: DataFrame


def ask_until_done(plan: DataFrame, ask: Callable[[DataFrame, int], DataFrame]) -> Asked:
    """Work through ``plan`` (:func:`cached_work.review_plan`). ``ask(files, round)`` sends the requests of a round and
    returns the responses that came, rows ``(FILE, response[, request_error])``.

    A round asks for the first file of each open content. If its answer is no review, the next round asks for the next file
    of that content, and so on until one has a review or none is left; a file without any answer stays open. A
    round reads the answers of the round before it only, and has at most one row for each content.
    """
    todo = plan.filter((F.col("action") == "review") & ~reviews.oversize(F.col("n_chars"))).select(*FILE, "content_hash")
    todo, seen = written_counting(todo, "asked", rows=F.lit(True))
    asked, answers, n = [], [], 0
    while seen["rows"] or not asked:
        n += 1
        asked.append(todo.withColumn("round", F.lit(n)))
        came = ask(todo, n).join(todo.select(*FILE), FILE, "left_semi")
        answers.append(written(reviews.ingest(came).withColumn("round", F.lit(n)), "answers"))
        todo, seen = written_counting(cached_work.retries(plan, answers[-1]).select(*FILE, "content_hash"), "asked", rows=F.lit(True))
    every = reduce(DataFrame.unionByName, answers)
    oversize = reviews.oversize_reviews(plan.filter("action <> 'cached'"))
    done = cached_work.planned_reviews(plan, reviews.reviews(every).unionByName(oversize))
    return Asked(reduce(DataFrame.unionByName, asked), every, done)
