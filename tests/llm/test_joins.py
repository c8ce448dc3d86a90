import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from changelens.llm import components, line_dedup, ngram_join, texts


def brute_components(rows):
    """(n_shingles, component id, number of the component) of rows (id, text), by their place."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    found = components.Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                found.join(i, j)
    members = defaultdict(list)
    for i, root in enumerate(found.roots()):
        members[root].append(rows[i][0])
    least = {root: min((x for x in some if x is not None), default=None) for root, some in members.items()}
    return [(len(s), least[root], root) for s, root in zip(sets, found.roots(), strict=True)]


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["changed", "altered", "moved", "new"]) + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture(scope="module")
def near_copies(prose):
    """Large groups of short, middling and long near copies, a shared passage, and texts that stand alone."""
    rng = random.Random(3)
    texts_ = [prose(i, rng.randint(1, 120)) for i in range(40)]
    for seed, n, copies in ((500, 45, 50), (501, 160, 40), (502, 900, 6), (503, 12, 30)):
        base = prose(seed, n)
        texts_ += [edited(rng, base, rng.randrange(1 + n // 20)) for _ in range(copies)]
    passage = prose(600, 60)
    texts_ += [prose(700 + i, rng.randint(5, 90)) + passage for i in range(40)]
    texts_ += ["one two", "One  TWO", "one two three", "", None, " ", "x"]
    rows = list(enumerate(texts_))
    return rows + [(None, texts_[60]), (None, "all alone here"), (5, texts_[100]), (7, texts_[7])]


@pytest.mark.parametrize("weight", [2_000_000, 1500])
def test_components_equal_brute_force(spark, near_copies, monkeypatch, weight):
    monkeypatch.setattr(components, "TASK_WEIGHT", weight)
    docs = spark.createDataFrame(near_copies, "doc_id LONG, text STRING").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()]
    expected = [(i, n, c) for (i, _), (n, c, _) in zip(near_copies, brute_components(near_copies), strict=True)]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x) for x in r))
    assert len({c for _, _, c in expected}) < len(expected) - 60
    assert order(got) == order(expected)


def test_prefix_index_loses_no_link(near_copies):
    """Any two linked sets share an index key, whatever the classes of their shingles are."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 130))
        pool = rng.permutation(400).astype(texts.U64)
        a = pool[:n]
        b = np.concatenate([a[int(rng.integers(0, 1 + n // 8)) :], pool[n : n + int(rng.integers(0, 1 + n // 8))]])
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common) or len(a) == len(b) == common:
            continue
        held = np.where(pool < rng.integers(0, 400), 16, 2 + pool % 14).astype(np.uint8)  # some of them frequent
        known = dict(zip(pool.tolist(), held.tolist(), strict=True))
        index = []
        for s, other in ((a, b), (b, a)):
            shared = np.array([k for k in s if k in set(other.tolist()) or rng.random() < 0.5], texts.U64)
            classes = np.array([known[int(k)] for k in shared], np.uint8)
            order = np.lexsort((shared, classes))
            index.append(ngram_join.index_keys(len(s), shared[order], classes[order]))
        assert len(np.intersect1d(*index))


def test_first_of_each_component(spark, near_copies):
    schema = "doc_id LONG, text STRING"
    docs = spark.createDataFrame(near_copies, schema).selectExpr("*", "1 AS node", "2 AS root", "3 AS id", "4 AS h")
    left = ngram_join.first_of_each(docs)
    assert left.columns == docs.columns
    rows = [(i, t) for i, t, *_ in left.collect()]
    assert len(rows) == len({root for _, _, root in brute_components(near_copies)})
    assert all(c == i for (_, c, _), (i, _) in zip(brute_components(rows), rows, strict=True))


def test_joins_of_odd_rows(odd_documents):
    found = sorted((r.doc_id if r.doc_id is not None else 99, r.n_shingles, r.component_id) for r in ngram_join.join(odd_documents).collect() if r.n_shingles)
    assert [(i, c) for i, _, c in found] == [(-2, -2), (7, 7), (7, 7), (7, 7), (9, 9), (10, 10), (11, 11), (12, 12), (99, None)]
    assert ngram_join.join(odd_documents).count() == odd_documents.count()
    assert ngram_join.join(odd_documents.filter("false")).count() == 0
    assert ngram_join.first_of_each(odd_documents.filter("false")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def changed(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "z"])
    return "".join(line)


def test_banded_distances():
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcd e") for _ in range(rng.randint(16, 50))) for _ in range(40)]
    pairs = [(x, changed(rng, x, rng.randrange(5))) for x in lines for _ in range(10)] + [(x, y) for x in lines for y in lines]
    pairs += [(x.replace("a", "é").replace("b", "語"), y.replace("a", "é")) for x, y in pairs]
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= line_dedup.EDITS and len(b) >= 16]
    all_lines = [line_dedup.characters(x.encode()) for p in pairs for x in p]
    assert {x.dtype.itemsize for x in all_lines} == {1, 4}
    got = line_dedup.distances(all_lines, np.arange(0, len(all_lines), 2), np.arange(1, len(all_lines), 2))
    for (a, b), d in zip(pairs, got, strict=True):
        assert min(d, 3) == min(edit_distance(a, b), 3)


def test_segment_keys_lose_no_pair():
    rng = random.Random(6)
    for _ in range(400):
        a = "".join(rng.choice("abcdeé語🙂 ") for _ in range(rng.randint(16, 80)))
        b = changed(rng, a, rng.randrange(3))
        if len(b) < 16 or edit_distance(a, b) > 2:
            continue
        text, bounds = texts.utf8(pa.array([a, b, "too short"]))
        line, keys = line_dedup.segment_keys(text, bounds[:-1], bounds[1:])
        assert line.max() < 2
        assert np.intersect1d(keys[line == 0], keys[line == 1]).size


def brute_dedup(rows):
    """New texts of rows (id, text), whose ids are in order and distinct."""
    seen = [(i, k, line) for i, text in rows for k, line in enumerate((text or "").split("\n")) if line.strip()]
    sets = components.Sets(len(seen))
    for x in range(len(seen)):
        for y in range(x):
            a, b = seen[x][2], seen[y][2]
            if a == b or min(len(a), len(b)) >= 16 and abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                sets.join(x, y)
    gone = {(i, k) for (i, k, _), root, x in zip(seen, sets.roots(), range(len(seen)), strict=True) if root != x}
    return {i: text if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in rows}


@pytest.fixture(scope="module")
def shared_lines():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdeilmnorstué") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(6) for _ in range(4)]
    rows = []
    for i in range(60):
        own = [line(rng.randint(1, 7)) for _ in range(4)] + [changed(rng, rng.choice(common), rng.randrange(4)) for _ in range(2)] + ["", "  "]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    chinese = "".join(rng.choice("日本語文字列東京大阪") for _ in range(20))
    rows += [(70, chinese), (71, chinese[:7] + "山川" + chinese[9:]), (72, "Read more\n" + chinese[1:]), (73, "Read more\nRead mores\n五字以下行"), (74, "五字以下行\nRead more")]
    return rows + [(100, rows[0][1]), (101, ""), (102, None), (103, common[0]), (104, "\n" + common[0] + "\n" + common[0])]


@pytest.mark.parametrize("weight", [2_000_000, 400])
def test_lines_equal_brute_force(spark, shared_lines, monkeypatch, weight):
    monkeypatch.setattr(components, "TASK_WEIGHT", weight)
    docs = spark.createDataFrame(shared_lines, "doc_id LONG, text STRING").repartition(4)
    got = {r.doc.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert got == brute_dedup(shared_lines)


def test_cleaned_lines_of_odd_rows(spark, odd_documents):
    left = line_dedup.clean(odd_documents)
    assert left.schema == odd_documents.schema
    rows = left.collect()
    assert len(rows) == odd_documents.count()  # equal rows are one document
    assert all(r.n_chars in (None, 0, 1, 4, 30, 40, 70_000) or r.n_chars == len(r.text) for r in rows)
    assert line_dedup.clean(odd_documents.filter("false")).count() == 0
    copy = odd_documents.filter("doc_id IN (9, 12)").unionByName(odd_documents.filter("doc_id = 9").drop("doc_id").selectExpr("20 AS doc_id", "*"))
    left = {r.doc_id: r.text for r in line_dedup.clean(copy).collect()}
    assert len(left[9]) > 0.9 * len(odd_documents.filter("doc_id = 9").first().text)
    assert 20 not in left  # no word is left of it


def test_many_copies_of_a_line_are_compared_in_few_pairs(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    base, lines = [rng.choice(words) for _ in range(60)], set()
    while len(lines) < 900:
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(60)] = rng.choice(words)
        line = " ".join(copy)
        at = rng.randrange(len(line))
        lines |= {line, line[:at] + rng.choice(["", "x", "xy", "Straße"]) + line[at + 1 :]}
    lines = sorted(lines)
    rng.shuffle(lines)
    asked, apart = [], np.setdiff1d
    monkeypatch.setattr(line_dedup.np, "setdiff1d", lambda new, old: asked.append(len(new)) or apart(new, old))
    got = line_dedup._links(pa.table({"line": pa.array([x.encode() for x in lines], pa.binary())}))
    assert sum(asked) < 50 * len(lines)

    coded = [line_dedup.characters(x.encode()) for x in lines]
    sets = components.Sets(len(lines))
    for i, x in enumerate(lines):
        near = np.array([j for j in range(i) if abs(len(lines[j]) - len(x)) <= line_dedup.EDITS and len(Counter(lines[j]) - Counter(x)) <= 2], np.int64)
        if len(near):
            hit = line_dedup.distances(coded, near, np.full(len(near), i)) <= line_dedup.EDITS
            for j in near[hit].tolist():
                sets.join(i, j)
    assert got.tolist() == sets.roots().tolist() and len(set(got.tolist())) < len(lines)
