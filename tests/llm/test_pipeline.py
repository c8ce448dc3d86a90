import re

import corpus_pipeline
import pyarrow as pa
import pytest

from changelens.llm import line_dedup
from changelens.llm.batches import BATCH_ROWS


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """Clean documents, copies, near copies, benchmark passages, junk and rows without text."""
    folder = tmp_path_factory.mktemp("corpus")
    items = [(i, prose(1000 + i, 30)) for i in range(3)]
    rows = [(i, prose(i, 150), "en") for i in range(40)]
    rows += [(100 + i, prose(i, 150), "en") for i in range(5)]
    rows += [(200, re.sub("harbour", "port", prose(7, 150), count=1), "en")]
    rows += [(300 + i, prose(50 + i, 90) + text + prose(60 + i, 90), "en") for i, text in items]
    rows += [(400, "spam " * 300, "en"), (401, None, None), (402, "", "fr"), (403, "too short", "de"), (None, prose(80, 100), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == columns
            left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(left["quality_rules"]) == {*range(40), *range(100, 105), 200, 300, 301, 302, None}
    long = lambda t: [x for x in t.split("\n") if len(x) >= line_dedup.LEAST_CHARS]
    assert all(long(left["line_dedup"][i]) == long(left["quality_rules"][i]) for i in range(40))
    lines = [x for t in left["line_dedup"].values() for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))  # shorter lines that came before are gone
    last = left["benchmark_decontamination"]
    assert set(range(40)) <= set(last) and not {200, *range(100, 105)} & {i for i in last if i in left["line_dedup"] and len(last[i]) > 400}
    words = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    for _, item in items:
        windows = [" ".join(words(item).split()[k : k + 10]) for k in range(len(words(item).split()) - 9)]
        assert not any(w in words(t) for t in last.values() for w in windows)
    pieces = docs.selectExpr("inline(pieces)").groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_results_are_made_in_small_batches_also_later(spark, corpus):
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Bytes", "Records")]
    before = [spark.conf.get(name, None) for name in names]
    spark.conf.set(names[1], "10000")
    try:
        stage = dict(corpus_pipeline.STAGES)["benchmark_decontamination"]
        docs = stage(spark, spark.range(3 * BATCH_ROWS).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1), corpus[0])
        rows = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n LONG").collect()
        assert sum(r.n for r in rows) == 3 * BATCH_ROWS and max(r.n for r in rows) <= BATCH_ROWS
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
