"""Source trees, change snapshots, signatures, routing and the stream."""

import hashlib
import hmac
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changelens.functions.signature import hmac_sha256, signature_accepted
from changelens.operators import import_graph, reach
from changelens.operators.code_facts import code_facts
from changelens.plans.review import ImportGraphs
from changelens.sources import sinks, snapshots
from changelens.sources.review_cache import ReviewCache
from changelens.sources.tree import read_tree, tree_files
from changelens.storage import written
from changelens.streaming import event_reviews, hourly, webhooks


def test_tree(spark, tmp_path):
    root = tmp_path / "net tools+v2"
    files = {
        "net/__init__.py": "from net import wire", "net/wire.py": "import net.codec.bits", "net/codec/__init__.py": "",
        "net/codec/bits.py": "import struct", "net/codec/_fast.py": "from net.codec.bits import swap", "bench/load.py": "import net.wire\nimport bench.plot",
        "bench/plot.py": "import bench.load", ".ci/check.py": "", "setup.py": "import tomllib",
        "env/lib/skip.py": "import net", "bench/node_modules/x/skip.py": "", "net/README.md": "import net",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "cp1252.py").write_bytes(b"import net # \x80")
    tree = read_tree(spark, str(root)).cache()
    rows = {r.filename: r for r in tree.collect()}
    assert set(rows) == {n for n in files if "skip" not in n and n.endswith(".py")} | {"cp1252.py"}
    assert rows["cp1252.py"].code is None and rows["net/codec/__init__.py"].module == "net.codec"
    graph = ImportGraphs(written(code_facts(tree_files(tree, "sample")), "facts"))
    assert {(e.src, e.dst) for e in graph.edges.collect()} == {
        ("net.wire", "net.codec.bits"), ("net.codec._fast", "net.codec.bits"), ("bench.load", "net.wire"),
        ("bench.load", "bench.plot"), ("bench.plot", "bench.load")}
    alone = import_graph.isolated_modules(graph.nodes, graph.edges).collect()
    assert {r.module for r in alone} == {"net", "net.codec", ".ci.check", "setup", "cp1252"}
    starts = graph.nodes.filter("module IN ('net.codec.bits', 'bench.plot')")
    assert {(r.start, r.module) for r in reach.impact(starts, graph.folded).collect()} == {
        *[("net.codec.bits", m) for m in ("net.wire", "net.codec._fast", "bench.load", "bench.plot")], ("bench.plot", "bench.load")}


def test_snapshot(spark):
    rows = [("r", 1, "a.py", "modified", 3, None), ("r", 1, "b.py", "removed", 0, 9), ("r", 1, "c.md", "added", 1, 1),
            ("r", 1, "d.py", "renamed", None, None), ("r", 2, "x.md", "added", 5, 0)]
    events = spark.createDataFrame(rows, "repo STRING, pr_number LONG, filename STRING, status STRING, additions INT, deletions INT")
    snapshot = snapshots.pr_file_snapshot(events)
    assert {r.filename: r.lines_changed for r in snapshot.collect()} == {"a.py": 3, "d.py": 0}
    assert [r.pr_number for r in snapshots.without_python(events).collect()] == [2]
    contents = spark.createDataFrame([("r", 1, "a.py", b"x = 1"), ("r", 1, "d.py", b"\xff")], "repo STRING, pr_number LONG, filename STRING, content BINARY")
    contents = contents.withColumn("code", snapshots.decoded(F.col("content")))
    assert [(r.filename, r.code) for r in snapshots.with_code(snapshot, contents).collect()] == [("a.py", "x = 1")]


@pytest.mark.parametrize("secret", [b"k", b"x" * 64, b"y" * 65, b"long" * 50, b"\x00\xff"])
def test_hmac(spark, secret):
    bodies = ["", "{}", "ünïcode", "z" * 1000]
    rows = spark.createDataFrame([(b,) for b in bodies], "body STRING").select("body", hmac_sha256(secret, F.col("body")).alias("h")).collect()
    assert {r.body: r.h for r in rows} == {b: hmac.new(secret, b.encode(), hashlib.sha256).hexdigest() for b in bodies}


def test_missing_signature_is_refused(spark):
    rows = spark.createDataFrame([(None,), ("",), ("anything",)], "header STRING")
    for secret, want in ((b"", [False, False, True]), (b"s", [False, False, False])):
        got = rows.select(signature_accepted(secret, F.col("header"), F.lit("{}"))).collect()
        assert [r[0] for r in got] == want


def _event(event, body, secret=b"s"):
    text = body if isinstance(body, str) else json.dumps(body)
    return event, text, "sha256=" + hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()


def _change(action, pr=1, repo="r"):
    return {"action": action, "pull_request": {"number": pr}, "repository": {"full_name": repo}}


def test_routing(spark):
    cases = [
        (_event("pull_request", _change("opened"), b"wrong"), "rejected"),
        (_event("ping", {}), "pong"),
        (_event("ping", "not json"), "unreadable"),
        (_event("push", _change("opened")), "ignored_event"),
        (_event(None, _change("opened")), "ignored_event"),
        (_event("pull_request", _change("closed")), "ignored_action"),
        (_event("pull_request", {"number": 1}), "ignored_action"),
        (_event("pull_request", '{"action": "closed", "action": "opened"}'), "process"),
        (_event("pull_request", '{"action": "opened", "score": NaN}'), "process"),
        (_event("pull_request", ' {"action": "opened"} \n'), "process"),
        *[(_event("pull_request", text), "unreadable") for text in (
            "", "{'action': 'opened'}", '{"action": "opened"} more', '{"action": "opened"}}', '{"action": "opened"}, {}',
            '{"action": "opened"}, "x": 1', '{"action": "opened"}], [1', '{"action": "opened"')],
        *[(_event("pull_request", text), "ignored_action") for text in ("[1]", '"opened"', "1", "null")],
        *[(_event("pull_request", _change(a)), "process") for a in ("opened", "synchronize", "reopened")],
    ]
    table = spark.createDataFrame([(n, *c) for n, (c, _) in enumerate(cases)], "n INT, event STRING, body STRING, signature STRING")
    assert [r.route for r in webhooks.routed(table, b"s").orderBy("n").collect()] == [want for _, want in cases]


def test_stream(spark, tmp_path):
    """Two batches: copies are reviewed once, the second change finds them cached, a replay changes nothing."""
    code = "def twice(n):\n    return 2 * n\n"
    files = [("r", 1, "a.py", code), ("r", 1, "copy.py", code), ("r", 1, "bad.py", "class (:"), ("r", 2, "z.py", code)]
    contents = spark.createDataFrame(files, "repo STRING, pr_number LONG, filename STRING, code STRING")
    listed = contents.selectExpr("repo", "pr_number", "filename", "'added' AS status", "1 AS additions", "0 AS deletions")
    listed = listed.union(spark.createDataFrame([("r", 3, "README.md", "added", 1, 0)], listed.schema))
    answers = contents.selectExpr("repo", "pr_number", "filename", """concat('{"filename": "', filename, '"}') AS response""")
    review = webhooks.WebhookReview(
        file_events=lambda: listed, contents=lambda: contents, answers=lambda: answers,
        cache=ReviewCache.create(spark, str(tmp_path / "cache")), out=str(tmp_path / "out"), secret=b"s",
    )
    schema = "event STRING, body STRING, signature STRING"
    for n, prs in enumerate(([1, 1, 3], [2])):
        rows = [_event("pull_request", _change("opened", pr)) for pr in prs] + [_event("ping", {})]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in/{n}"))

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
        webhooks.start(stream, review, str(tmp_path / checkpoint)).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out/status")).collect()
        return {r.pr_number: (r.status, r.files_analyzed, r.files_to_review, r.cached, r.errors, r.batch) for r in rows}

    first = run("checkpoint")
    assert first == {1: ("processed", 3, 2, 0, 1, 0), 2: ("processed", 1, 0, 1, 0, 1), 3: ("no_python_files", 0, 0, 0, 0, 0)}
    assert [json.loads(r.review)["filename"] for r in review.cache.entries().collect()] == ["a.py"]
    assert run("new-checkpoint") == first  # all batches once more
    assert review.cache.entries().count() == 1


def test_published_batches(spark, tmp_path, monkeypatch):
    """A batch is published once; one that broke off is written anew; large repositories have several files."""
    monkeypatch.setattr(sinks, "FILE_ROWS", 40)
    output = sinks.BatchOutput.create(spark, str(tmp_path / "out"))
    rows = spark.range(400).selectExpr("concat('org/', CASE WHEN id < 300 THEN 'hot' ELSE concat('r', id % 4) END) AS repo", "id").repartition(16)
    assert output.rows(rows.schema).collect() == []
    assert output.publish(rows, 0)
    files = sorted(tmp_path.glob("out/data/batch=0/*/*.parquet"))
    assert len(files) <= 8 + 4
    assert not output.publish(rows.limit(3), 0)  # a replay
    assert sorted(tmp_path.glob("out/data/batch=0/*/*.parquet")) == files
    broken = tmp_path / "out/data/batch=1/repo=org%2Fhot"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(files[0].read_bytes())
    assert output.rows(rows.schema).count() == 400  # no mark, not there
    assert output.publish(rows.filter("id < 5"), 1)
    assert output.publish(rows.limit(0), 2)
    got = sorted((r.batch, r.repo, r.id) for r in output.rows(rows.schema).collect())
    assert got == sorted([(0, r.repo, r.id) for r in rows.collect()] + [(1, "org/hot", i) for i in range(5)])


def test_hourly_counts(spark, tmp_path):
    """Repeated deliveries count once, late ones not at all, and hours come when they are over."""
    schema = "event_id LONG, ts TIMESTAMP, repo STRING, event STRING"
    parts = [
        [(1, "10:05", "a"), (2, "10:40", "a"), (2, "10:40", "a"), (3, "11:30", "b")],
        [(3, "11:30", "b"), (4, "10:50", "a"), (5, "15:10", "a")],  # 4 is late, but by less than two hours
        [(6, "11:00", "a"), (7, "13:20", "a"), (5, "15:10", "a"), (8, "18:00", "b")],  # 6 is too late
    ]
    output = sinks.BatchOutput.create(spark, str(tmp_path / "out"))
    seen = []
    for part in parts:
        rows = [(n, f"2024-03-01 {at}:00", repo, "push") for n, at, repo in part]
        spark.createDataFrame(rows, "event_id LONG, ts STRING, repo STRING, event STRING").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        hourly.start_counts(stream, output, str(tmp_path / "checkpoint")).awaitTermination()
        found = output.rows(spark.createDataFrame([], hourly.COUNTS).schema).collect()
        seen.append(sorted((r.repo, r.hour.strftime("%H"), r.n_events) for r in found))
    assert seen == [[], [("a", "10", 3), ("b", "11", 1)], [("a", "10", 3), ("a", "13", 1), ("a", "15", 1), ("b", "11", 1)]]


@pytest.mark.parametrize("cuts", [[8], [1, 4, 8]])
def test_reviews_by_event_do_not_depend_on_the_batches(spark, tmp_path, capsys, cuts):
    """Every event is a review that finds what earlier events left in the cache, of other changes too."""
    same, other, wrong = "def twice(n):\n    return 2 * n\n", "x = 1\n", "y = 2\n"
    files = [(1, "a.py", same), (1, "copy.py", same), (1, "bad.py", "class (:"), (2, "z.py", same), (2, "o.py", other), (4, "w.py", wrong), (4, "w2.py", wrong), (5, "w3.py", wrong)]
    contents = spark.createDataFrame([("org/r", *f) for f in files], "repo STRING, pr_number LONG, filename STRING, code STRING")
    listed = contents.selectExpr("repo", "pr_number", "filename", "'added' AS status", "1 AS additions", "0 AS deletions")
    listed = listed.union(spark.createDataFrame([("org/r", 3, "README.md", "added", 1, 0)], listed.schema))
    no_review = "pr_number = 4 AND filename = 'w.py'"
    answers = contents.selectExpr("repo", "pr_number", "filename", f"""CASE WHEN {no_review} THEN '[]' ELSE concat('{{"filename": "', filename, '"}}') END AS response""")
    tables = {}
    for name, table in (("listed", listed), ("contents", contents), ("answers", answers)):
        sinks.publish(table, str(tmp_path / name))
        tables[name] = spark.read.schema(table.schema).parquet(str(tmp_path / name))
    output = {name: sinks.BatchOutput.create(spark, str(tmp_path / name)) for name in ("status", "reviews")}
    review = event_reviews.EventReviews(
        lambda: tables["listed"], lambda: tables["contents"], lambda: tables["answers"], ReviewCache.create(spark, str(tmp_path / "cache")), **output)
    schema = "event_id LONG, ts TIMESTAMP, event STRING, body STRING, signature STRING"
    prs = [2, 1, 1, 3, 2, 4, 5, 4]
    rows = [(n, f"2024-03-01 00:0{n}:00", *_event("pull_request", _change("opened", pr, "org/r"))) for n, pr in enumerate(prs)]
    begin = 0
    for end in cuts:
        part = spark.createDataFrame(rows[begin:end], schema.replace("TIMESTAMP", "STRING")).withColumn("ts", F.col("ts").cast("timestamp"))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        event_reviews.start(stream, b"s", review, str(tmp_path / "checkpoint")).awaitTermination()
        begin = end
    status = output["status"].rows(spark.createDataFrame([], event_reviews.STATUS).schema).collect()
    got = {r.event_id: (r.pr_number, r.run, r.status, r.files_analyzed, r.files_to_review, r.cached, r.errors) for r in status}
    done = "processed"
    assert got == {
        0: (2, 1, done, 2, 2, 0, 0), 1: (1, 1, done, 3, 0, 2, 1), 2: (1, 2, done, 3, 0, 2, 1), 3: (3, 1, "no_python_files", 0, 0, 0, 0),
        4: (2, 2, done, 2, 0, 2, 0), 5: (4, 1, done, 2, 2, 0, 1), 6: (5, 1, done, 1, 0, 1, 0), 7: (4, 2, done, 2, 0, 2, 0),
    }
    given = output["reviews"].rows(spark.createDataFrame([], event_reviews.REVIEWS).schema).collect()
    assert {(r.event_id, r.filename): r.reported_filename for r in given} == {
        (0, "z.py"): "z.py", (0, "o.py"): "o.py", (1, "a.py"): "z.py", (1, "copy.py"): "z.py", (2, "a.py"): "z.py", (2, "copy.py"): "z.py",
        (4, "z.py"): "z.py", (4, "o.py"): "o.py", (5, "w2.py"): "w2.py", (6, "w3.py"): "w2.py", (7, "w.py"): "w2.py", (7, "w2.py"): "w2.py"}
    capsys.readouterr()
    event_reviews.of_repositories(tables["contents"], ["org/r", "org/s"]).explain("formatted")
    assert "PartitionFilters: [repo#" in capsys.readouterr().out


def test_changes_share_groups_of_the_state():
    """One call numbers the events of several changes, each from its own number before."""
    class State:
        exists, get = True, ('{"b": 2}',)

        def update(self, value):
            self.get = value

    state = State()
    parts = [[(5, 3, "a"), (1, 1, "b")], [(2, 2, "a"), (9, 3, "b"), (4, 3, "c")]]
    frames = [pd.DataFrame([(e, pd.Timestamp(2024, 1, ts), c, 7) for e, ts, c in part], columns=["event_id", "ts", "change", "changes"]) for part in parts]
    found = pd.concat(event_reviews._numbered((7,), iter(frames), state))
    assert dict(zip(found["event_id"], found["run"])) == {2: 1, 5: 2, 1: 3, 9: 4, 4: 1}
    assert json.loads(state.get[0]) == {"a": 2, "b": 4, "c": 1}


def test_large_batches_are_parsed_in_few_tasks(spark):
    assert [webhooks.parse_tasks(spark, n) for n in (0, 1, 200, 201, 800, 8_000)] == [1, 1, 1, 2, 4, 4]
    assert webhooks.parse_tasks(spark, 40_000) == 20 and webhooks.parse_tasks(spark, 2_000_001) == 1001
