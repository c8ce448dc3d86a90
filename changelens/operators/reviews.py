"""Review requests out, model answers in.

The model call is outside: requests are exported as a table and answers come back as one. ``reviews``
rows are ``(repo, pr_number, filename, error_kind, reported_filename, summary, overall_score, issues)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changelens import KEY
from changelens.functions import review_json
from changelens.functions.review_json import SEVERITIES, read_review
from changelens.functions.scoring import ANSWER_TOKENS, cost_usd, input_tokens, score_band
from changelens.operators.code_facts import FILE, fact_counts

# Longer files are not sent (characters), and the text such a file gets.
MAX_CHARS = 50000
TOO_LARGE = "File too large for review (>50k chars)"
# Summaries of reviews that failed.
FAILED = "Review failed: "
BAD_SCHEMA = "Invalid schema: "

#: ``line_digits`` has a line number that does not fit ``line``, which is NULL then.
ISSUES = "ARRAY<STRUCT<line: LONG, severity: STRING, category: STRING, message: STRING, suggestion: STRING, line_digits: STRING>>"
REVIEW_DDL = f"error_kind STRING, error_detail STRING, filename STRING, summary STRING, overall_score INT, issues {ISSUES}"

#: Wording of a request; callers may pass their own. Placeholders are columns of the request row.
REQUEST_TEMPLATE = """File {filename}: {n_functions} functions, {n_classes} classes, average complexity {avg_complexity}.
Files affected by a change of it: {dependencies}.
Review the code and answer with a JSON object (filename, issues, summary, overall_score).

{code}"""

cloudpickle.register_pickle_by_value(review_json)


def oversize(n_chars: Column) -> Column:
    return n_chars > MAX_CHARS


def oversize_reviews(files: DataFrame) -> DataFrame:
    """The review a file gets that is too long to be sent."""
    return files.filter(oversize(F.col("n_chars"))).select(
        *FILE, F.lit("oversize").alias("error_kind"), F.col("filename").alias("reported_filename"),
        F.lit(TOO_LARGE).alias("summary"), F.lit(0).alias("overall_score"), _no_issues().alias("issues"),
    )


def _filled(template: str) -> Column:
    """``template`` with its ``{column}`` placeholders replaced, as one concat."""
    parts = []
    for piece in template.split("{"):
        column, brace, text = piece.partition("}")
        parts += [F.col(column).cast("string"), F.lit(text)] if brace else [F.lit(piece)]
    return F.concat(*parts)


def review_requests(plan: DataFrame, facts: DataFrame, files: DataFrame, template: str = REQUEST_TEMPLATE) -> DataFrame:
    """One request per planned review. The plan has a few files per change; with a large file table Spark's
    runtime bloom filter drops all other code before the join's shuffle."""
    todo = plan.filter((F.col("action") == "review") & ~oversize(F.col("n_chars"))).select(*FILE, "rank", "dependencies")
    about = facts.select(*FILE, "avg_complexity", *fact_counts()).drop("n_imports")
    wanted = todo.join(about, FILE).join(files.select(*FILE, "code"), FILE)
    return wanted.withColumn("prompt", _filled(template)).drop("code")


def review_costs(files: DataFrame) -> DataFrame:
    """Estimated tokens and USD of reviewing each file."""
    tokens = input_tokens(F.col("n_chars"))
    return files.select(
        *FILE, tokens.alias("input_tokens"), F.lit(ANSWER_TOKENS).alias("output_tokens"),
        cost_usd(tokens).alias("cost_usd"),
    )


def review_spend(costs: DataFrame) -> DataFrame:
    """Tokens and USD of every change, of every repository and of all, in one pass. ``level`` tells which (``change``,
    ``repository``, ``all``), with NULL for what is summed over. USD are summed as decimals, so the order of rows does
    not show."""
    level = F.when(F.grouping("pr_number") == 0, "change").when(F.grouping("repo") == 0, "repository").otherwise("all")
    return costs.groupingSets([["repo", "pr_number"], ["repo"], []], "repo", "pr_number").agg(
        level.alias("level"), F.count("*").alias("n_files"), F.sum("input_tokens").alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"),
        F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"),
    )


def _read_answers(table: DataFrame, answer: str, kept: list[str]) -> DataFrame:
    review_type = T.StructType.fromDDL(REVIEW_DDL)
    fields = to_arrow_schema(review_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_review(text) for text in batch.column("_answer").to_pylist()]
            for issue in (issue for r in rows for issue in r["issues"]):
                line = issue["line"]
                if isinstance(line, str) or not -(2**63) <= line < 2**63:
                    issue["line"], issue["line_digits"] = None, str(line)
            columns = [pa.array([r[f.name] for r in rows], type=f.type) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + columns, [*kept, *(f"review_{n}" for n in fields.names)]
            )

    source = table.select(*kept, F.coalesce(answer, F.lit("")).alias("_answer"))
    renamed = [T.StructField(f"review_{f.name}", f.dataType) for f in review_type.fields]
    return source.mapInArrow(read, T.StructType([*source.select(*kept).schema.fields, *renamed]))


def _no_issues() -> Column:
    issues = T.StructType.fromDDL(REVIEW_DDL)["issues"].dataType
    return F.array().cast(issues)


def ingest(responses: DataFrame) -> DataFrame:
    """Read every answer: a valid review, or ``error_kind`` (``invalid_json``, ``invalid_schema``,
    ``not_object``) with the fields NULL. A ``request_error`` column, if present, marks requests that got no
    answer at all (``request_failed``)."""
    columns = [*FILE, "request_error"] if "request_error" in responses.columns else FILE
    read = _read_answers(responses, "response", columns)
    kind, detail = F.col("review_error_kind"), F.col("review_error_detail")
    if "request_error" in columns:
        failed = F.col("request_error").isNotNull()
        kind = F.when(failed, "request_failed").otherwise(kind)
        detail = F.when(failed, F.col("request_error")).otherwise(detail)
    return read.select(
        *FILE, kind.alias("error_kind"), detail.alias("error_detail"),
        F.col("review_filename").alias("reported_filename"), F.col("review_summary").alias("summary"),
        F.col("review_overall_score").alias("overall_score"), F.col("review_issues").alias("issues"),
    )


def reviews(ingested: DataFrame) -> DataFrame:
    """All reviews, failed answers as reviews of score 0. An answer that is no object gives none."""
    kind = F.col("error_kind")
    reason = (
        F.when(kind == "invalid_json", "Invalid JSON from model")
        .when(kind == "invalid_schema", F.concat(F.lit(BAD_SCHEMA), "error_detail"))
        .otherwise(F.col("error_detail"))
    )
    ok = kind == "ok"
    return ingested.filter(kind != "not_object").select(
        *FILE, "error_kind",
        F.when(ok, F.col("reported_filename")).otherwise(F.col("filename")).alias("reported_filename"),
        F.when(ok, F.col("summary")).otherwise(F.concat(F.lit(FAILED), reason)).alias("summary"),
        F.when(ok, F.col("overall_score")).otherwise(0).alias("overall_score"),
        F.when(ok, F.col("issues")).otherwise(_no_issues()).alias("issues"),
    )


def review_json_text() -> Column:
    """A review row as the JSON text kept in the cache. Where a line number is long, all of the review's are text."""

    def text(line: Callable[[Column], Column]) -> Column:
        names = ("severity", "category", "message", "suggestion")
        issues = F.transform("issues", lambda i: F.struct(line(i).alias("line"), *[i[n].alias(n) for n in names]))
        return F.to_json(F.struct(F.col("reported_filename").alias("filename"), issues.alias("issues"), "summary", "overall_score"))

    long = F.exists("issues", lambda i: i["line"].isNull())
    return F.when(long, text(lambda i: F.coalesce(i["line"].cast("string"), i["line_digits"]))).otherwise(text(lambda i: i["line"]))


def valid_reviews(cache: DataFrame, column: str) -> DataFrame:
    """Cache entries whose value is a valid review."""
    read = _read_answers(cache, column, cache.columns)
    return read.filter("review_error_kind = 'ok'").select(*cache.columns)


def read_reviews(table: DataFrame, column: str, kept: list[str]) -> DataFrame:
    """The fields of all values that are valid reviews, beside the ``kept`` columns."""
    read = _read_answers(table, column, kept)
    return read.filter("review_error_kind = 'ok'").select(
        *kept, F.col("review_error_kind").alias("error_kind"), F.col("review_filename").alias("reported_filename"),
        F.col("review_summary").alias("summary"), F.col("review_overall_score").alias("overall_score"),
        F.col("review_issues").alias("issues"),
    )


def failure_counts(ingested: DataFrame) -> DataFrame:
    return ingested.groupBy("repo", "error_kind").agg(F.count("*").alias("n_responses"))


def issues(reviews: DataFrame) -> DataFrame:
    """One row per issue."""
    return reviews.select(*FILE, F.posexplode("issues").alias("pos", "issue")).select(*FILE, "pos", "issue.*")


def severity_counts(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues per file and severity, zeros kept."""
    marks = reviews.select(*FILE, F.lit(None).cast("string").alias("severity")).unionByName(
        issues.select(*FILE, "severity")
    )
    counts = [F.count_if(F.col("severity") == level).alias(level) for level in SEVERITIES]
    return marks.groupBy(*FILE).agg(*counts)


def critical_files(issues: DataFrame) -> DataFrame:
    return issues.filter("severity = 'critical'").select(*FILE).distinct()


def score_bands(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("repo", score_band(F.col("overall_score")).alias("band")).agg(
        F.count("*").alias("n_files")
    )


def issue_totals(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues, critical issues and reviewed files of every change."""
    marks = reviews.select(*KEY, F.lit(1).alias("file"), F.lit(0).alias("issue"), F.lit(0).alias("critical")).unionByName(
        issues.select(*KEY, F.lit(0).alias("file"), F.lit(1).alias("issue"),
                      F.when(F.col("severity") == "critical", 1).otherwise(0).alias("critical"))
    )
    return marks.groupBy(*KEY).agg(
        F.sum("issue").alias("total_issues"), F.sum("critical").alias("total_critical"), F.sum("file").alias("n_files")
    )
