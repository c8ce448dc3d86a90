"""Requests, answers, comments and summaries."""

import json

import pytest
from pyspark.sql import functions as F

from changelens.functions.review_json import read_review
from changelens.functions.scoring import cost_usd, input_tokens
from changelens.operators import cached_work, comments, reviews
from changelens.operators.code_facts import code_facts
from changelens.plans.asking import ask_until_done
from changelens.plans.change_reviews import ChangeReviews
from changelens.sources.sinks import publish

ISSUE = {"line": 1, "severity": "high", "category": "bug", "message": "m"}


@pytest.mark.parametrize("text, kind, detail", [
    ('{"filename": "a.py"}', "ok", None),
    (' \n```json\n{"filename": "a.py"}\n```  ', "ok", None),
    ('```\n{"filename": "a.py"}', "ok", None),
    ("not json", "invalid_json", None),
    ("", "invalid_json", None),
    ('{"filename": "a.py"} trailing', "invalid_json", None),
    ("[1]", "not_object", "list"),
    ('"text"', "not_object", "str"),
    ("[" * 200_000, "not_object", "RecursionError"),
    ("{}", "invalid_schema", "filename"),
    ('{"filename": 3}', "invalid_schema", "filename"),
    ('{"filename": "a", "summary": null}', "invalid_schema", "summary"),
    ('{"filename": "a", "summary": "\\ud800"}', "invalid_schema", "summary"),
    ('{"filename": "a", "overall_score": 11}', "invalid_schema", "overall_score"),
    ('{"filename": "a", "overall_score": -1}', "invalid_schema", "overall_score"),
    ('{"filename": "a", "overall_score": 7.5}', "invalid_schema", "overall_score"),
    ('{"filename": "a", "overall_score": NaN}', "invalid_schema", "overall_score"),
    ('{"filename": "a", "issues": {}}', "invalid_schema", "issues"),
    ('{"filename": "a", "issues": [1]}', "invalid_schema", "issues"),
    (json.dumps({"filename": "a", "issues": [ISSUE, ISSUE | {"severity": "worst"}]}), "invalid_schema", "issues[1].severity"),
    (json.dumps({"filename": "a", "issues": [{k: v for k, v in ISSUE.items() if k != "line"}]}), "invalid_schema", "issues[0].line"),
    (json.dumps({"filename": "a", "issues": [ISSUE | {"line": 10**30}]}), "ok", None),
    ('{"filename": "a", "overall_score": 1%s}' % ("0" * 5000), "invalid_schema", "overall_score"),
    ('{"filename": "a", "summary": 1%s}' % ("0" * 5000), "invalid_schema", "summary"),
])
def test_answer_kinds(text, kind, detail):
    read = read_review(text)
    assert (read["error_kind"], read["error_detail"]) == (kind, detail)


@pytest.mark.parametrize("value, number", [(8, 8), (8.0, 8), ("7", 7), (" 7 ", 7), ("7.0", 7), (True, 1)])
def test_whole_numbers_in_other_forms(value, number):
    assert read_review(json.dumps({"filename": "a", "overall_score": value}))["overall_score"] == number


def test_defaults():
    read = read_review(json.dumps({"filename": "a", "issues": [ISSUE], "extra": 1}))
    assert (read["summary"], read["overall_score"], read["issues"]) == ("", 5, [ISSUE | {"suggestion": ""}])


RESPONSE = "repo STRING, pr_number LONG, filename STRING, response STRING, request_error STRING"


def test_ingest(spark):
    full = json.dumps({"filename": "other.py", "issues": [ISSUE, ISSUE | {"severity": "critical"}], "summary": "s", "overall_score": 4})
    rows = [("r", 1, "a.py", full, None), ("r", 1, "b.py", "garbage", None), ("r", 1, "c.py", "[1]", None),
            ("r", 1, "d.py", None, "Max retries exceeded"), ("r", 1, "e.py", '{"filename": "e", "overall_score": 99}', None)]
    ingested = reviews.ingest(spark.createDataFrame(rows, RESPONSE)).cache()
    kinds = {r.filename: r.error_kind for r in ingested.collect()}
    assert kinds == {"a.py": "ok", "b.py": "invalid_json", "c.py": "not_object", "d.py": "request_failed", "e.py": "invalid_schema"}
    done = {r.filename: r for r in reviews.reviews(ingested).collect()}
    assert set(done) == {"a.py", "b.py", "d.py", "e.py"}
    assert (done["a.py"].reported_filename, done["a.py"].summary, done["a.py"].overall_score, len(done["a.py"].issues)) == ("other.py", "s", 4, 2)
    assert {f: (done[f].summary, done[f].overall_score, done[f].issues) for f in ("b.py", "d.py", "e.py")} == {
        "b.py": ("Review failed: Invalid JSON from model", 0, []), "d.py": ("Review failed: Max retries exceeded", 0, []),
        "e.py": ("Review failed: Invalid schema: overall_score", 0, []),
    }
    # What goes into the cache is itself a valid review.
    cached = reviews.reviews(ingested).select(F.col("filename").alias("content_hash"), reviews.review_json_text().alias("review"))
    assert reviews.valid_reviews(cached, "review").count() == 4
    issues = reviews.issues(reviews.reviews(ingested))
    assert [(r.pos, r.severity, r.suggestion) for r in issues.orderBy("pos").collect()] == [(0, "high", ""), (1, "critical", "")]
    assert [r.filename for r in reviews.critical_files(issues).collect()] == ["a.py"]
    counts = {r.filename: (r.critical, r.high, r.medium, r.low, r.info) for r in reviews.severity_counts(reviews.reviews(ingested), issues).collect()}
    assert counts["a.py"] == (1, 1, 0, 0, 0) and counts["b.py"] == (0, 0, 0, 0, 0)


def test_requests_and_cost(spark, change):
    code = "def f(a): pass # "
    files = change({"a.py": code, "big.py": "#" * 50_001, "edge.py": "#" * 50_000})
    facts = code_facts(files).cache()
    plan = facts.selectExpr("repo", "pr_number", "filename", "1 AS rank", "2L AS dependencies", "n_chars", "'review' AS action")
    requests = reviews.review_requests(plan, facts, files, template="{filename}|{n_functions}|{n_classes}|{avg_complexity}|{dependencies}\n{code}")
    assert {r.filename: r.prompt[:20] for r in requests.collect()} == {"a.py": "a.py|1|0|1.0|2\ndef f", "edge.py": "edge.py|0|0|0.0|2\n##"}
    refused = reviews.oversize_reviews(facts).collect()
    assert [(r.filename, r.summary, r.overall_score, r.issues) for r in refused] == [("big.py", "File too large for review (>50k chars)", 0, [])]
    costs = {r.filename: (r.input_tokens, r.output_tokens, r.cost_usd) for r in reviews.review_costs(facts).collect()}
    assert costs["a.py"] == (504, 800, 0.003603)
    # Same figure as rounding in Python, for many lengths.
    rows = spark.range(20_000).select("id", cost_usd(input_tokens(F.col("id"))).alias("usd")).collect()
    assert all(r.usd == round((r.id // 4 + 500) * (0.80 / 1_000_000) + 800 * (4.00 / 1_000_000), 6) for r in rows)


FILE_ROW = "repo STRING, pr_number LONG, filename STRING"


def _reviewed(spark):
    """Three of the four files of a change are queued; one issue has a severity that no answer may hold."""
    queue = spark.createDataFrame([("z", 4, "n.py", 1), ("z", 4, "k.py", 2), ("z", 4, "m.py", 3)], f"{FILE_ROW}, rank INT")
    done = spark.createDataFrame([("z", 4, "k.py", "Unsafe loads", 0), ("z", 4, "m.py", "Slow in places", 6), ("z", 4, "n.py", "", 7),
                                  ("z", 4, "late.py", "Left over", 5)], f"{FILE_ROW}, summary STRING, overall_score INT")
    issues = spark.createDataFrame([
        ("z", 4, "k.py", 31, "critical", "security", "pickle of a request", "use JSON"), ("z", 4, "k.py", 78, "critical", "bug", "lock is kept", ""),
        ("z", 4, "k.py", 80, "high", "bug", "lost error", ""), ("z", 4, "m.py", 12, "medium", "performance", "sorts twice", "sort once"),
        ("z", 4, "m.py", 40, "info", "style", "long line", ""), ("z", 4, "m.py", 44, "blocker", "bug", "unknown kind", ""),
    ], f"{FILE_ROW}, line LONG, severity STRING, category STRING, message STRING, suggestion STRING")
    return queue, done, issues


def test_comments(spark):
    _, _, issues = _reviewed(spark)
    assert {r.line: r.body for r in comments.inline_comments(issues).collect()} == {
        31: "🔴 **CRITICAL** — security\n\npickle of a request\n\n**Suggestion:** use JSON", 78: "🔴 **CRITICAL** — bug\n\nlock is kept",
        80: "🟠 **HIGH** — bug\n\nlost error", 12: "🟡 **MEDIUM** — performance\n\nsorts twice\n\n**Suggestion:** sort once",
        40: "💡 **INFO** — style\n\nlong line", 44: "⚪ **BLOCKER** — bug\n\nunknown kind",
    }


def test_summary(spark):
    queue, done, issues = _reviewed(spark)
    known = issues.filter("severity <> 'blocker'")
    parts = comments.pr_summaries(queue, done, known, title="Findings").first().body.split("\n### ")
    assert parts == [
        "## Findings\n", "🟢 `n.py` — 7/10\n> \n\n✅ No issues found\n",
        "🔴 `k.py` — 0/10\n> Unsafe loads\n\n🔴 critical: 2 | 🟠 high: 1\n",
        "🟡 `m.py` — 6/10\n> Slow in places\n\n🟡 medium: 1 | 💡 info: 1\n\n---\n**Total:** 5 issues across 3 files\n\n"
        "🔴 **2 critical issue(s) require immediate attention**",
    ]
    mild = comments.pr_summaries(queue.filter("filename = 'm.py'"), done, known).first().body
    assert mild.startswith("## Review Summary\n") and mild.endswith("**Total:** 2 issues across 1 files")
    totals = reviews.issue_totals(done, known).first()
    assert (totals.total_issues, totals.total_critical, totals.n_files) == (5, 2, 4)
    assert {(r.band, r.n_files) for r in reviews.score_bands(done).collect()} == {("red", 1), ("green", 1), ("yellow", 2)}


def test_publishing(spark, tmp_path):
    log = spark.createDataFrame([
        ("r", 1, "a.py", "inline", 1, True, None), ("r", 1, "a.py", "inline", 5, False, "line must be part of the diff"),
        ("r", 1, None, "summary", None, False, "down"), ("s", 2, None, "change", None, False, "not found"),
        ("s", 3, None, "summary", None, True, None),
    ], "repo STRING, pr_number LONG, filename STRING, kind STRING, line INT, accepted BOOLEAN, message STRING")
    assert {tuple(r) for r in comments.publish_results(log).collect()} == {
        ("r", 1, "posted", 1, True, 2, None), ("s", 2, "error", 0, False, 0, "not found"), ("s", 3, "posted", 0, True, 0, None)}
    assert {r.error for r in comments.delivery_errors(log).collect()} == {
        "a.py:5 — line must be part of the diff", "Summary comment failed: down", "not found"}
    publish(log, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("repo = 'r'").count() == 3 and {p.name for p in (tmp_path / "out").glob("repo=*")} == {"repo=r", "repo=s"}


def test_reviews_of_changes(spark, change):
    """Cached, answered, taken over, too long, asked again, never answered; a cached value that is no review is not used."""
    queue = spark.createDataFrame([
        ("r", 1, "hit.py", 1, "known", 10), ("r", 1, "bad.py", 2, "twice", 10), ("r", 1, "big.py", 3, "long", 50_001),
        ("r", 2, "ask.py", 1, "twice", 10), ("r", 2, "same.py", 2, "twice", 10), ("r", 2, "big2.py", 3, "long", 50_001),
        ("r", 3, "none.py", 1, "open", 10), ("r", 3, "stale.py", 2, "spoilt", 10), ("r", 4, "list.py", 1, "lists", 10),
    ], f"{FILE_ROW}, rank INT, content_hash STRING, n_chars INT")
    cache = spark.createDataFrame([
        ("known", json.dumps({"filename": "old.py", "summary": "seen", "overall_score": 9, "issues": [ISSUE]})),
        ("spoilt", "{}"), ("unused", "no review"),
    ], "content_hash STRING, review STRING")
    answers = spark.createDataFrame([
        ("r", 1, "hit.py", '{"filename": "hit.py", "summary": "not asked for"}'), ("r", 1, "bad.py", "[1]"),
        ("r", 1, "big.py", '{"filename": "big.py"}'), ("r", 2, "ask.py", json.dumps({"filename": "ask.py", "issues": [ISSUE, ISSUE]})),
        ("r", 2, "same.py", "[2]"), ("r", 3, "stale.py", "text"), ("r", 4, "list.py", "[]"), ("x", 9, "else.py", "[]"),
    ], f"{FILE_ROW}, response STRING")
    done = ChangeReviews(queue, cache, answers)
    got = {r.filename: (r.action, r.error_kind, r.reported_filename, r.overall_score, len(r.issues)) for r in done.reviews.collect()}
    assert got == {
        "hit.py": ("cached", "ok", "old.py", 9, 1), "big.py": ("review", "oversize", "big.py", 0, 0),
        "ask.py": ("reuse", "ok", "ask.py", 5, 2), "same.py": ("reuse", "ok", "ask.py", 5, 2), "big2.py": ("reuse", "oversize", "big.py", 0, 0),
        "stale.py": ("review", "invalid_json", "stale.py", 0, 0),
    }
    facts = code_facts(change({"a.py": "x = 1"}))
    posting = spark.createDataFrame([("r", 1, "down"), ("r", 4, "nothing to post")], "repo STRING, pr_number LONG, message STRING")
    assert {(r.pr_number, r.step, r.message) for r in done.errors(facts, posting).collect()} == {
        (1, 5, "Review error in bad.py: list"), (4, 5, "Review error in list.py: list"), (1, 6, "Comment posting error: down")}
    entries = {r.content_hash: json.loads(r.review) for r in done.cache_entries.collect()}
    assert {h: e["filename"] for h, e in entries.items()} == {"twice": "ask.py", "long": "big.py", "spoilt": "stale.py"}
    assert {(r.pr_number, r.total_issues, r.n_files) for r in done.totals().collect()} == {(1, 1, 2), (2, 4, 3), (3, 0, 1)}
    assert done.comments().count() == 5 and {r.pr_number for r in done.summaries().collect()} == {1, 2, 3}
    assert done.retries().count() == 0  # the only file with the last list's content was asked


def test_line_numbers_of_any_length(spark):
    """Long numbers stay exact in the table, and in the cache."""
    lines = [3, -(2**63), 2**63, 2**70, -(10**300), "00" + "9" * 40, "1_000.0", "-" + "7" * 6000]
    raw = [json.dumps({"filename": "a.py", "issues": [ISSUE | {"line": line}]}) for line in lines] + ['{"filename": "a.py", "issues": [{"line": %s}]}' % ("8" * 6000)]
    raw[-1] = raw[-1].replace("}]}", ', "severity": "high", "category": "bug", "message": "m"}]}')
    table = spark.createDataFrame([("r", 1, f"{n}.py", text) for n, text in enumerate(raw)], "repo STRING, pr_number LONG, filename STRING, response STRING")
    want = [(3, None), (-(2**63), None), (None, str(2**63)), (None, str(2**70)), (None, str(-(10**300))), (None, "9" * 40), (1000, None),
            (None, "-" + "7" * 6000), (None, "8" * 6000)]
    read = reviews.reviews(reviews.ingest(table)).cache()
    got = {r.filename: (r.error_kind, r.issues[0].line, r.issues[0].line_digits) for r in read.collect()}
    assert got == {f"{n}.py": ("ok", *w) for n, w in enumerate(want)}
    again = reviews.read_reviews(read.select("filename", reviews.review_json_text().alias("review")), "review", ["filename"])
    assert {r.filename: (r.issues[0].line, r.issues[0].line_digits) for r in again.collect()} == {f"{n}.py": w for n, w in enumerate(want)}


def test_asking_until_done(spark):
    """Files with one content are asked in turn until one has a review; a file without an answer stays open."""
    rows = [("r", 1, n, f"f{n}.py", h, 10) for n, h in enumerate("aaaabbbcd")] + [("r", 1, 20, "long.py", "e", 60_000)]
    queue = spark.createDataFrame(rows, "repo STRING, pr_number LONG, rank INT, filename STRING, content_hash STRING, n_chars LONG")
    cache = spark.createDataFrame([("d", '{"filename": "old.py"}', None)], "content_hash STRING, review STRING, created_at TIMESTAMP")
    plan = cached_work.review_plan(queue, cache)
    good, sent = {"f2.py", "f3.py"}, []

    def ask(files, n):
        asked = sorted(r.filename for r in files.collect())
        sent.append(asked)
        answers = [("r", 1, f, json.dumps({"filename": f} if f in good else [])) for f in [*asked, "f3.py"] if f != "f7.py"]
        return spark.createDataFrame(answers, "repo STRING, pr_number LONG, filename STRING, response STRING")

    done = ask_until_done(plan, ask)
    assert sent == [["f0.py", "f4.py", "f7.py"], ["f1.py", "f5.py"], ["f2.py", "f6.py"]]
    assert {(r.filename, r.round) for r in done.asked.collect()} == {(f, n + 1) for n, asked in enumerate(sent) for f in asked}
    assert {r.filename: r.reported_filename for r in done.reviews.collect()} == {"f2.py": "f2.py", "f3.py": "f2.py", "long.py": "long.py"}


def test_spend(spark):
    rows = [("a", 1, "x", 100, 800, 0.1), ("a", 1, "y", 50, 800, 0.2), ("a", 2, "x", 1, 800, 0.000001), ("b", 1, "x", 7, 800, 1.0)]
    costs = spark.createDataFrame(rows, "repo STRING, pr_number LONG, filename STRING, input_tokens LONG, output_tokens INT, cost_usd DOUBLE")
    got = {(r.level, r.repo, r.pr_number): (r.n_files, r.input_tokens, r.output_tokens, r.cost_usd) for r in reviews.review_spend(costs).collect()}
    assert got == {
        ("change", "a", 1): (2, 150, 1600, 0.3), ("change", "a", 2): (1, 1, 800, 0.000001), ("change", "b", 1): (1, 7, 800, 1.0),
        ("repository", "a", None): (3, 151, 2400, 0.300001), ("repository", "b", None): (1, 7, 800, 1.0), ("all", None, None): (4, 158, 3200, 1.300001)}
