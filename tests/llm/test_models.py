import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelens.llm import language_id, quality_grades, samples, texts, toxicity

SOUNDS = {"aa": "the and with ough ing ness stood wick", "bb": "der und schaft keit unge lich zwei", "cc": "que ción mente ado ñas los pero"}


def speech(seed, lang, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    draw = lambda *shape: rng.standard_normal(shape) * 0.3
    net = language_id.Network(["a", "b"], draw(2, 256, 9), draw(2, 3, 6), draw(2, 3, 3), draw(6, 2), draw(2))
    windows, labels, lengths = rng.integers(97, 101, (3, 5)).astype(np.uint8), np.array([0, 1, 1]), np.array([5, 3, 4])

    def loss():
        logs = language_id.log_probabilities(net, language_id.states(net, windows))
        return -sum(logs[t, i, labels[i]] for i in range(3) for t in range(lengths[i])) / lengths.sum()

    for p, g in zip(net.parameters(), language_id.gradients(net, windows, labels, lengths), strict=True):
        for place in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g).ravel())[:4]]:
            old = p[place]
            p[place] = old + 1e-3
            up = loss()
            p[place] = old - 1e-3
            slope = (up - loss()) / 2e-3
            p[place] = old
            assert g[place] == pytest.approx(slope, rel=0.02, abs=1e-4)


def test_languages(spark, odd_documents):
    rows = [(i, speech(i, lang, 30), lang) for i, lang in enumerate(list(SOUNDS) * 50)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(150))
    held = [i for i in range(150) if found[i].held_out]
    assert np.mean([found[i].lang_pred == rows[i][2] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found.values())
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.col("lang")))
    assert {r.doc_id: r for r in language_id.identify(other).collect()} == found  # nothing of the held-out fold counts
    odd = language_id.identify(odd_documents).collect()
    assert len(odd) == odd_documents.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (3, 4, 5))
    assert language_id.identify(odd_documents.filter("false")).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "train", lambda labelled: seen.extend(labelled))
    rows = [(i, f"words of language {i % 70}", f"l{i % 70:02}") for i in range(700)] + [(1000 + i, "of one " + "long text é🙂 " * 3000, "long") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    language_id.identify(docs)
    assert {lang for lang, _ in seen} == {"long", *(f"l{k:02}" for k in range(70))}
    assert all(len(t.encode()) <= samples.SAMPLE_TEXT_BYTES and "\ufffd" not in t for _, t in seen)
    assert all(len(t) > 5000 and t.startswith("of one long") for lang, t in seen if lang == "long")


def test_only_documents_with_text_are_ranked(spark):
    rows = [(i, "a text" if i % 10 > 7 else (None, "")[i % 3 == 0], i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, label INT")
    found = samples.labelled(docs.drop("label"), docs.select("doc_id", "label"), 10)
    assert [label for label, _ in found].count(0) == 10 and [label for label, _ in found].count(1) == 10
    assert len(samples.labelled(docs.drop("label"), docs.select("doc_id", "label"), 10, most=6)) == 6
    many = docs.selectExpr("doc_id", "doc_id AS label")
    assert len(samples.labelled(docs.drop("label"), many, 10, most=6)) == docs.filter("text != ''").count()


def test_samples_of_common_labels_are_the_least_hashes(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CAST(id % 50 = 0 AS INT) AS label")
    found = samples.labelled(docs.drop("label"), docs.select("doc_id", "label"), 30)
    order = docs.orderBy(F.xxhash64("doc_id")).collect()
    for label in (0, 1):
        least = {r.text for r in [r for r in order if r.label == label][:30]}
        assert {t for own, t in found if own == label} == least
    assert samples.shares(docs.select("doc_id", "label")) == {0: 0.98, 1: 0.02}


def test_every_grade_is_learned_at_its_share(spark):
    rows = [(i, f"grade{i % 20} " * 9, i % 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, stars INT")
    grader = quality_grades.fit(samples.labelled(docs, docs.selectExpr("doc_id", "stars AS label"), 10))
    assert grader.grades.tolist() == list(range(20)) and (np.diff(grader.thresholds) > 0).all()
    # equal texts: the probabilities are the shares of the corpus, whatever the sample's are
    same = quality_grades.fit([(g, "equal words") for g in (0, 1, 2) for _ in range(50)], {0: 0.7, 1: 0.2, 2: 0.1})
    tails = same.tails(*texts.utf8(pa.array(["equal words"])))[0]
    assert tails == pytest.approx([0.3, 0.1], abs=0.02)


def test_reported_speech():
    grammar = toxicity.Grammar()
    some = [
        'He said: "you idiot"', "She wrote: you are an idiot", '"You idiot", he said', '"You idiot!" he said', "\u201cYou idiot\u201d, he said", "\u00abidiot\u00bb dit il",
        "You idiot, he said so", 'an "idiot" you are', '"Idiot', 'Fine "day". You idiot',
    ]
    text, bounds = texts.utf8(pa.array(some))
    found = [{toxicity.PATTERNS[k][2] for k in np.flatnonzero(row)} for row in grammar.patterns(text, bounds)]
    assert found == [{"reported"}] * 6 + [{"plain"}] * 4


def test_patterns_of_clauses():
    grammar = toxicity.Grammar()
    some = ["You are an idiot. Fine day.", "not an idiot", "he said idiot", "I will kill you!", "calm words", ""]
    text, bounds = texts.utf8(pa.array(some))
    found = [[toxicity.PATTERNS[k] for k in np.flatnonzero(row)] for row in grammar.patterns(text, bounds)]
    assert found[0] == [(toxicity.INSULT, True, "plain")]
    assert found[1] == [(toxicity.INSULT, False, "negated")]
    assert found[2] == [(toxicity.INSULT, True, "reported")]
    assert found[3] == [(toxicity.THREAT, True, "plain")]
    assert found[4] == found[5] == []
    score = grammar.scores(text, bounds)
    assert score[0] > score[1] > score[4] == score[5]


def test_toxic_texts_are_learned(spark, prose, odd_documents):
    bad = ["blorgface", "blorghead", "idiot"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 3]} {prose(i + 500, 5)}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic INT")
    found = {r.doc_id: r for r in toxicity.score(docs.drop("toxic"), docs.drop("text")).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert [r[0] for r in held] == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i].predicted == label for i, _, label in held]) > 0.95
    odd = toxicity.score(odd_documents, docs.drop("text")).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    none = docs.drop("text").filter("false")
    assert toxicity.score(odd_documents.filter("false"), none).count() == 0


def test_grades(spark, prose, odd_documents):
    kinds = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: t]
    rows = [(i, kinds[i % 3](prose(i, 50)), i % 3) for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, stars INT")
    found = {r.doc_id: r for r in quality_grades.grade(docs.drop("stars"), docs, F.col("stars")).collect()}
    held = [r for r in rows if found[r[0]].held_out]
    assert np.mean([abs(found[i].expected_grade - stars) < 0.5 for i, _, stars in held]) > 0.9
    assert all(found[i].selected == (found[i].tail_probability >= 0.5) for i, _, _ in rows)
    grader = quality_grades.fit(samples.labelled(docs, docs.selectExpr("doc_id", "stars AS label"), 100))
    assert (np.diff(grader.thresholds) > 0).all() and len(grader.thresholds) == 2
    odd = quality_grades.grade(odd_documents, docs.filter("false"), F.col("stars")).collect()
    assert len(odd) == odd_documents.count() and all(r.expected_grade == 0 for r in odd)
    assert quality_grades.grade(odd_documents.filter("false"), docs, F.col("stars")).count() == 0
