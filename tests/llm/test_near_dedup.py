import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import components, near_dedup


def brute(rows):
    """(doc_id, n_shingles, component id, kept) of rows (id, text), by exact sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    found = components.Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                found.join(i, j)
    members = defaultdict(list)
    for i, root in enumerate(found.roots()):
        members[root].append(rows[i][0])
    least = {root: min((x for x in some if x is not None), default=None) for root, some in members.items()}
    return [(i, len(s), least[root], i == least[root]) for (i, _), s, root in zip(rows, sets, found.roots(), strict=True)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["changed", "altered", "moved", "new"]) + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(prose):
    """Groups of short, middling and long near copies, passages that many share, texts of one to three words."""
    rng = random.Random(5)
    rows = [prose(i, rng.randint(1, 120)) for i in range(30)]
    for seed, n, copies_ in ((500, 45, 40), (501, 160, 40), (502, 900, 8), (503, 12, 30), (504, 2500, 5)):
        base = prose(seed, n)
        rows += [edited(rng, base, rng.randrange(1 + n // 30)) for _ in range(copies_)]
    passage = prose(600, 60)
    rows += [prose(700 + i, rng.randint(2, 60)) + passage for i in range(40)]
    rows += ["one two", "One  TWO", "one two three", "One\ttwo\nthree", "", None, " ", "x", "X"]
    numbered = list(enumerate(rows))
    return numbered + [(None, rows[60]), (None, "all alone here today"), (None, None), (5, rows[100]), (7, rows[7]), (7, rows[7])]


@pytest.mark.parametrize("weight", [2_000_000, 1500])
def test_components_equal_brute_force(spark, copies, monkeypatch, weight):
    monkeypatch.setattr(components, "TASK_WEIGHT", weight)
    docs = spark.createDataFrame(copies, "doc_id LONG, text STRING").repartition(5)
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    expected = brute(copies)
    assert sum(not kept for *_, kept in expected) > 100
    assert ordered(got) == ordered(expected)


def test_linked_sets_meet_under_an_indexed_value_and_pass_the_estimate(spark):
    """Sets of any size that are just linked: sketches have the common values asked for, and are not filtered out."""
    rng = np.random.default_rng(2)
    sizes = sorted({*range(1, 30), *range(100, 180, 3), 250, 290, 300, 400, 700, 1500, 5000})
    spare = spark.createDataFrame([(n,) for n in sizes], "n LONG").select("n", near_dedup.least_common(F.col("n")).alias("least")).collect()
    least = {r.n: r.least for r in spare}
    for n in sizes:
        for _ in range(12):
            both = n - int(rng.integers(0, 1 + 15 * n // 100))  # of the first set; the second may have as many of its own as allowed
            union = 100 * both // 85
            values = rng.choice(1 << 62, union, replace=False).astype(np.uint64)
            a, b = np.sort(values[:n]), np.sort(np.concatenate([values[:both], values[n:]]))
            common = len(np.intersect1d(a, b))
            assert 100 * common >= 85 * len(np.union1d(a, b))
            sketch_a, sketch_b = a[: near_dedup.SKETCH], b[: near_dedup.SKETCH]
            lists = near_dedup._Lists([sketch_a, sketch_b, sketch_a[:1]])
            assert 1 in lists.near(0, least[n], np.array([False, True, True]))
            common, among = lists.common(0, np.array([1, 2]), near_dedup.SKETCH)
            shared = np.intersect1d(sketch_a, sketch_b)
            assert common.tolist() == [len(shared), 1]
            assert among[0] == np.isin(np.union1d(sketch_a, sketch_b)[: near_dedup.SKETCH], shared).sum()
            assert len(shared) >= least[n] == near_dedup._least_common(np.array([n]))[0]
            assert near_dedup._may_link(len(a), np.array([len(b)]), common[:1], among[:1]).all()


def test_unlikely_pairs_are_filtered():
    rng = np.random.default_rng(3)
    values = np.sort(rng.choice(1 << 62, 3000, replace=False).astype(np.uint64))
    a, b = values[rng.random(3000) < 0.6], values[rng.random(3000) < 0.6]
    common, among = near_dedup._Lists([a[:128], b[:128]]).common(0, np.array([1]), 128)
    assert not near_dedup._may_link(len(a), np.array([len(b)]), common, among).any()


def test_odd_documents(spark, odd_documents):
    got = [tuple(r) for r in near_dedup.near_duplicates(odd_documents).collect()]
    assert ordered(got) == ordered(brute([(r.doc_id, r.text) for r in odd_documents.collect()]))


def test_empty_table(spark):
    found = near_dedup.near_duplicates(spark.createDataFrame([], "doc_id LONG, text STRING, node LONG, root LONG"))
    assert found.collect() == []
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
