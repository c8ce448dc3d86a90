"""Ranking, the review cache and the work plan."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from changelens import skew
from changelens.operators import cached_work, ranking, reviews
from changelens.operators.code_facts import FILE, code_facts
from changelens.plans.review import ImportGraphs, error_log, pr_status, priority_scores
from changelens.sources import review_cache
from changelens.sources.review_cache import ReviewCache, cache_rows, latest
from changelens.storage import written

# log and alarm both import probe, alarm also log; probe and log import calib.
FILES = {
    "calib.py": "def slope(a, b):\n    return b - a if a or b else 0\n",
    "probe.py": "import calib\n\nclass Probe:\n    def read(self):\n        while True:\n            if calib.slope(1, 2):\n                return 0\n",
    "log.py": "import probe, calib\n\nLINES = []\n",
    "alarm.py": "from probe import Probe\nfrom log import LINES\n",
}
LINES = {"calib.py": 15, "probe.py": 35, "log.py": 200, "alarm.py": 5}


def test_ranking_of_a_change(change):
    facts = written(code_facts(change(FILES, LINES)), "facts")
    scores = written(priority_scores(facts), "scores")
    queue = ranking.review_queue(scores, 2).orderBy("rank").collect()
    assert [(q.filename, q.score, q.complexity, q.dependencies, q.lines_changed) for q in queue] == [
        ("log.py", 23.0, 1, 1, 200), ("probe.py", 11.5, 3, 2, 35),
    ]
    assert ranking.queue_next(scores).first().filename == "log.py"
    assert {r.filename: r.score for r in ranking.queue_rest(scores).collect()} == {"probe.py": 11.5, "calib.py": 10.5, "alarm.py": 2.5}
    assert ranking.queue_size(scores).first()["size"] == 4
    assert ranking.review_queue(scores, 99).count() == 4


def test_missing_lines_and_broken_files(change):
    # a.py reports 0 changed lines, b.py none at all, my.pytest/x.py ranks under a name the graph lacks.
    facts = written(code_facts(change({
        "a.py": "x = 1\ny = 2\n", "b.py": "x = 1\ny = 2\nz = 3\n", "bad.py": "def (:", "my.pytest/x.py": "", "c.py": "import my.pytest.x",
    }, {"a.py": 0})), "facts")
    scores = {r.filename: (r.complexity, r.dependencies, r.lines_changed) for r in priority_scores(facts).collect()}
    assert scores == {"a.py": (1, 0, 0), "b.py": (1, 0, 3), "my.pytest/x.py": (1, 0, 0), "c.py": (1, 0, 1)}


def test_unreadable_file_spoils_only_the_graph_of_its_change(change):
    deep = "x = " + "-" * 100_000 + "1"
    facts = written(code_facts(change({"a.py": "import b", "b.py": "", "deep.py": deep}, pr=1).unionByName(
        change({"a.py": "import b", "b.py": ""}, pr=2))), "facts")
    graphs = ImportGraphs(facts)
    assert {e.pr_number for e in graphs.edges.collect()} == {2}
    assert {(r.pr_number, r.filename): r.dependencies for r in priority_scores(facts, graphs).collect()} == {
        (1, "a.py"): 0, (1, "b.py"): 0, (2, "a.py"): 0, (2, "b.py"): 1}
    errors = error_log(facts)
    assert [(r.step, r.message.split(": ")[0]) for r in errors.orderBy("step").collect()] == [(1, "AST error in deep.py"), (2, "Graph error")]
    queue = ranking.review_queue(priority_scores(facts, graphs))
    status = pr_status(facts, facts, queue.selectExpr("*", "false AS is_cached"), errors)
    assert {(r.pr_number, r.files_analyzed, r.files_to_review, r.errors) for r in status.collect()} == {(1, 2, 2, 2), (2, 2, 2, 0)}


def test_status_of_a_change_without_files(spark, change):
    facts = code_facts(change({"README.md": "# hi"}))
    none = spark.createDataFrame([], "repo STRING, pr_number LONG, filename STRING, is_cached BOOLEAN")
    changes = spark.createDataFrame([("t/r", 1)], "repo STRING, pr_number LONG")
    row = pr_status(changes, facts, none, error_log(facts)).first()
    assert (row.status, row.files_analyzed, row.files_to_review, row.cached, row.errors) == ("no_python_files", 0, 0, 0, 0)


def _entry(code, review, second):
    return code, review, datetime(2024, 1, 1, 0, 0, second)


def test_cache(spark, tmp_path):
    schema = "code STRING, review STRING, created_at TIMESTAMP"
    cache = ReviewCache.create(spark, str(tmp_path / "cache"))
    assert cache.entries().count() == 0
    cache.append(cache_rows(spark.createDataFrame([_entry("a", "1", 1), _entry("b", "2", 2)], schema)), 0)
    cache.append(cache_rows(spark.createDataFrame([_entry("a", "3", 3)], schema)), 1)
    cache.append(cache_rows(spark.createDataFrame([_entry("a", "4", 4)], schema)), 1)  # batch 1 again

    def now(**options):
        again = ReviewCache(spark, cache.root)  # as a new process would open it
        return sorted(r.review for r in again.entries(**options).collect())

    assert now() == ["2", "4"]
    assert now(before_batch=1) == ["1", "2"]
    stats = cache.stats().first()
    assert (stats.entries, stats.location) == (2, cache.root) and stats.files >= 2
    cache.compact()
    assert now() == ["2", "4"]
    assert now(before_batch=1) == ["1", "2"]  # a replayed batch still finds what was there before it
    assert cache.generation() == 1
    next((tmp_path / "cache" / "runs" / "run=1").glob("prefix=*")).joinpath("part-broken.parquet").write_bytes(b"no parquet")
    assert now() == ["2", "4"]  # an unreadable file is skipped
    cache.clear()
    assert now() == []


def test_cache_beside_its_writer(spark, tmp_path, monkeypatch, capsys):
    """What is added during a compaction stays, a second compaction at one time fails, runs are merged, lookups are pruned."""
    monkeypatch.setattr(review_cache, "MOST_RUNS", 2)
    cache = ReviewCache.create(spark, str(tmp_path / "cache"))

    def add(batch, **reviews):
        rows = [_entry(code, review, batch) for code, review in reviews.items()]
        cache.append(cache_rows(spark.createDataFrame(rows, "code STRING, review STRING, created_at TIMESTAMP")), batch)

    def now(**options):
        return sorted(r.review for r in ReviewCache(spark, cache.root).entries(**options).collect())

    add(0, a="a0", b="b0")
    add(1, a="a1")
    publish = cache._publish

    def slow(generation, upto, runs):
        add(2, c="c2")  # arrives while the run is written
        publish(generation, upto, runs)

    monkeypatch.setattr(cache, "_publish", slow)
    cache.compact()
    assert now() == ["a1", "b0", "c2"] and now(before_batch=1) == ["a0", "b0"] and now(before_batch=2) == ["a1", "b0"]

    def second(generation, upto, runs):
        publish(generation, upto, runs)  # another process was first
        publish(generation, upto, runs)

    monkeypatch.setattr(cache, "_publish", second)
    with pytest.raises(AnalysisException):
        cache.compact()
    monkeypatch.setattr(cache, "_publish", publish)
    assert now() == ["a1", "b0", "c2"]
    for batch in (3, 4):
        add(batch, a=f"a{batch}", d=f"d{batch}")
        cache.compact()
    assert len(cache._record()["runs"]) <= 2 and now() == ["a4", "b0", "c2", "d4"] and now(before_batch=4) == ["a3", "b0", "c2", "d3"]

    asked = cache_rows(spark.createDataFrame([_entry("b", "", 0)], "code STRING, review STRING, created_at TIMESTAMP"))
    assert "b0" in now(asked=asked)
    capsys.readouterr()
    cache.entries(asked=asked).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert len(filters) == 2 and all("prefix" in line for line in filters)


def _queue(spark, rows):
    return spark.createDataFrame(rows, "repo STRING, pr_number LONG, filename STRING, rank INT, content_hash STRING")


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 1])
def test_review_plan(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    queue = _queue(spark, [
        ("r", 2, "a.py", 1, "h1"), ("r", 1, "b.py", 2, "h1"), ("r", 1, "c.py", 1, "h2"), ("r", 3, "d.py", 1, "h3"),
        ("r", 3, "e.py", 2, "h4"), *[("s", n, "copy.py", 1, "h1") for n in range(9)],
    ])
    valid = '{"filename": "x.py", "overall_score": 7}'
    cache = spark.createDataFrame([("h3", valid), ("h4", '{"summary": "no filename"}')], "content_hash STRING, review STRING")
    plan = cached_work.review_plan(queue, cache).cache()
    got = {(r.repo, r.pr_number, r.filename): (r.action, r.from_pr_number, r.from_filename) for r in plan.collect()}
    assert got == {
        ("r", 1, "b.py"): ("review", 1, "b.py"), ("r", 1, "c.py"): ("review", 1, "c.py"), ("r", 2, "a.py"): ("reuse", 1, "b.py"),
        ("r", 3, "d.py"): ("cached", None, None), ("r", 3, "e.py"): ("review", 3, "e.py"),
    } | {("s", n, "copy.py"): ("reuse", 1, "b.py") for n in range(9)}
    split = {r.filename: r.is_cached for r in cached_work.cache_split(queue.filter("repo = 'r'"), cache).collect()}
    assert split == {"a.py": False, "b.py": False, "c.py": False, "d.py": True, "e.py": True}  # presence is enough here
    answers = spark.createDataFrame([("r", 1, "b.py", '{"filename": "b.py", "summary": "s"}'), ("r", 1, "c.py", "[1]")], "repo STRING, pr_number LONG, filename STRING, response STRING")
    done = cached_work.planned_reviews(plan, reviews.reviews(reviews.ingest(answers)))
    assert {(r.pr_number, r.filename, r.reported_filename) for r in done.filter("repo = 'r'").collect()} == {(1, "b.py", "b.py"), (2, "a.py", "b.py")}
    assert done.filter("repo = 's'").count() == 9
    assert cached_work.retries(plan, reviews.ingest(answers)).count() == 0  # h2 has no other file

    # The first answer for h1 is no review: the next file in order is asked, and those after it take its review.
    refused = answers.withColumn("response", F.lit("[1]"))
    again = cached_work.retries(plan, reviews.ingest(refused)).collect()
    assert [(r.repo, r.pr_number, r.filename, r["rank"]) for r in again] == [("r", 2, "a.py", 1)]
    second = refused.union(spark.createDataFrame([("r", 2, "a.py", '{"filename": "a.py"}')], answers.schema))
    done = cached_work.planned_reviews(plan, reviews.reviews(reviews.ingest(second)))
    assert {(r.repo, r.pr_number, r.reported_filename) for r in done.collect()} == {("r", 2, "a.py")} | {("s", n, "a.py") for n in range(9)}
    assert cached_work.retries(plan, reviews.ingest(second)).count() == 0


def test_salted_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i % 3 * (i % 7 == 0), i) for i in range(200)] + [(9, 999)], "k INT, id INT")
    right = spark.createDataFrame([(0, "zero"), (1, "one")], "k INT, name STRING")
    hot = skew.hot_keys(left.groupBy("k").count(), ["k"], "count")
    assert {r.k for r in hot.collect()} == {0}
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.salted_join(left, right, ["k"], how, hot, left["id"])
        want = left.join(right, "k", how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), how
    assert skew.hot_keys(right.groupBy("k").count(), ["k"], "count") is None


def test_last_write_wins(spark):
    rows = cache_rows(spark.createDataFrame([_entry("x", str(n), n) for n in range(20)], "code STRING, review STRING, created_at TIMESTAMP"))
    assert [r.review for r in latest(rows.repartition(5)).collect()] == ["19"]


def test_cached_values_are_checked_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def review(content_hash):
        read.add(1)
        return '{"filename": "x.py"}' if content_hash < "h5" else "[1]"

    queue = _queue(spark, [("r", n, f"{n}.py", 1, f"h{n % 10}") for n in range(30)])
    cache = spark.createDataFrame([(f"h{n}",) for n in range(8)], "content_hash STRING").withColumn("review", review.asNondeterministic()("content_hash"))
    plan = cached_work.review_plan(queue, cache)
    got = {r.pr_number: (r.action, r.from_pr_number) for r in plan.collect()}
    assert got == {n: ("cached", None) if n % 10 < 5 else ("review" if n < 10 else "reuse", n % 10) for n in range(30)}
    assert read.value == 8
