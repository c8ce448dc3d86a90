"""Comment and summary texts, and the outcome of publishing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.functions.review_json import SEVERITIES
from changelens.functions.scoring import score_band
from changelens.operators.code_facts import FILE
from changelens.operators.reviews import severity_counts

# The signs used in published texts.
SEVERITY_SIGN = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "💡"}
OTHER_SIGN = "⚪"
BAND_SIGN = {"green": "🟢", "yellow": "🟡", "red": "🔴"}
# Texts that readers of comments look for.
NO_ISSUES = "✅ No issues found"
SUGGESTION = "**Suggestion:** "
TOTAL = "**Total:** "
ALARM = " critical issue(s) require immediate attention**"
SUMMARY_REFUSED = "Summary comment failed: "


def _sign(signs: dict[str, str], key: Column, default: str) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def inline_comments(issues: DataFrame) -> DataFrame:
    """Path, line and text of the comment for every issue."""
    head = F.concat(
        _sign(SEVERITY_SIGN, F.col("severity"), OTHER_SIGN), F.lit(" **"), F.upper("severity"), F.lit("** — "), "category"
    )
    advice = F.when(F.col("suggestion") != "", F.concat(F.lit(f"\n{SUGGESTION}"), "suggestion"))
    body = F.concat_ws("\n", head, F.concat(F.lit("\n"), "message"), advice)  # NULL advice is left out
    kept = [c for c in issues.columns if c not in (*FILE, "line")]
    return issues.select(*KEY, F.col("filename").alias("path"), "line", body.alias("body"), *kept)


def _file_section() -> Column:
    """The part of a summary about one file."""
    counts = F.concat_ws(" | ", *[
        F.when(F.col(level) > 0, F.concat(F.lit(f"{SEVERITY_SIGN[level]} {level}: "), F.col(level).cast("string")))
        for level in SEVERITIES
    ])
    score = F.col("overall_score")
    return F.concat(
        F.lit("### "), _sign(BAND_SIGN, score_band(score), ""), F.lit(" `"), "filename", F.lit("` — "),
        score.cast("string"), F.lit("/10\n> "), "summary", F.lit("\n\n"),
        F.when(counts == "", NO_ISSUES).otherwise(counts), F.lit("\n"),
    )


def pr_summaries(queue: DataFrame, reviews: DataFrame, issues: DataFrame, title: str = "Review Summary") -> DataFrame:
    """One summary text per change over its queued, reviewed files in queue order. The queue holds the top
    few files of each change, which bounds the length of a text."""
    ordered = reviews.select(*FILE, "summary", "overall_score").join(queue.select(*FILE, "rank"), FILE)
    listed = issues.join(queue.select(*FILE), FILE, "left_semi")
    per_file = ordered.join(severity_counts(ordered, listed), FILE)
    n_issues = sum((F.col(level) for level in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    grouped = per_file.withColumn("section", _file_section()).groupBy(*KEY).agg(
        F.expr("listagg(section, '\n') WITHIN GROUP (ORDER BY rank)").alias("sections"),
        F.sum(n_issues).alias("n_issues"), F.sum("critical").alias("n_critical"), F.count("*").alias("n_files"),
    )
    alarm = F.when(F.col("n_critical") > 0, F.concat(
        F.lit(f"\n\n{SEVERITY_SIGN['critical']} **"), F.col("n_critical").cast("string"),
        F.lit(ALARM),
    )).otherwise("")
    body = F.concat(
        F.lit(f"## {title}\n\n"), "sections", F.lit(f"\n---\n{TOTAL}"), F.col("n_issues").cast("string"),
        F.lit(" issues across "), F.col("n_files").cast("string"), F.lit(" files"), alarm,
    )
    return grouped.select(*KEY, body.alias("body"))


def delivery_errors(log: DataFrame) -> DataFrame:
    """Refused deliveries as text. ``log`` rows are ``(key, kind, filename, line, accepted, message)`` with
    kind ``inline``, ``summary`` or ``change`` (the change itself could not be opened)."""
    inline = F.concat("filename", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "message")
    text = F.when(F.col("kind") == "inline", inline).when(
        F.col("kind") == "summary", F.concat(F.lit(SUMMARY_REFUSED), "message")
    ).otherwise(F.col("message"))
    return log.filter("NOT accepted").select(*KEY, "kind", text.alias("error"))


def publish_results(log: DataFrame) -> DataFrame:
    """Outcome per change. Only accepted inline comments count; the summary counts as posted even when it
    was refused; a change that could not be opened has status ``error`` and nothing posted."""
    refused = ~F.col("accepted")
    opening = F.col("kind") == "change"
    outcome = log.groupBy(*KEY).agg(
        F.bool_or(opening & refused).alias("unreachable"),
        F.max(F.when(opening & refused, F.col("message"))).alias("message"),
        F.count_if((F.col("kind") == "inline") & F.col("accepted")).alias("inline"),
        F.count_if(~opening & refused).alias("refused"),
    )
    reached = ~F.col("unreachable")
    return outcome.select(
        *KEY, F.when(reached, "posted").otherwise("error").alias("status"),
        F.when(reached, F.col("inline")).otherwise(0).alias("inline_comments"), reached.alias("summary_posted"),
        F.when(reached, F.col("refused")).otherwise(0).alias("n_errors"), "message",
    )
