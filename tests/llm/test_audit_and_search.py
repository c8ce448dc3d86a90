import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import ranked_search, source_divergence


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_audit(rows):
    """Rows of the audit over (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (own[t] + 1) // total for t in kept}

        whole = sum((counts[lang, s] for s in sources), Counter())
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            above = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", above)):
                some.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(some) if part == "pair" or i < 200]
    return sorted(out)


@pytest.fixture(scope="module")
def sources(prose):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de", "日本", None])
        source = rng.choice(["hot", "hot", "hot", "a", "b", "c", "Ä", "z z", None])
        rows.append((prose(i % 120, rng.randint(0, 90)) + f" only{source}x", lang, source))
    rows += [(None, "en", "nothing"), ("", "xx", "a"), ("12 34", "xx", "b"), ("rare words", "yy", "a"), ("ſtraße ÉCOLE école\u0085Kelvin", "en", "a")] * 2
    rows += [(" ".join(f"t{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyz'[j // 100]}" for j in range(600)), "en", "long")] * 3
    return rows


@pytest.mark.parametrize(("bits", "tile", "cells"), [(64, 64, 400_000), (9, 2, 300), (64, 3, 1000)])
def test_audit_equals_brute_force(spark, sources, monkeypatch, bits, tile, cells):
    """Also with digests so short that most terms share theirs, and with several tiles and blocks."""
    monkeypatch.setattr(source_divergence, "TILE", tile)
    monkeypatch.setattr(source_divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(source_divergence, "TERMS_AT_ONCE", 7 if tile == 2 else 8192)
    monkeypatch.setattr(source_divergence, "CHUNK_BYTES", 20_000)
    docs = spark.createDataFrame(sources, "text STRING, lang STRING, source STRING").repartition(4)
    got = sorted(tuple(r) for r in source_divergence.audit(docs, bits).collect())
    expected = brute_audit(sources)
    assert max(r[5] for r in expected) == 200
    assert got == expected


def test_probabilities_are_exact_beyond_64_bits(spark):
    rows = [(0, 1), (7, 1000), (9_223_372_035, 10**12), (9_223_372_034, 10**12), (9_223_372_036, 10**12), (10**15, 3 * 10**15), (10**17 + 3, 10**17 + 3)]
    table = spark.createDataFrame(rows, "n LONG, total LONG")
    got = [r[0] for r in table.select(source_divergence.probability(F.col("n"), F.col("total"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // total for n, total in rows]


def test_audit_of_odd_and_empty_tables(spark, odd_documents):
    rows = [(r.text, r.lang, r.source) for r in odd_documents.collect()]
    assert sorted(tuple(r) for r in source_divergence.audit(odd_documents).collect()) == brute_audit(rows)
    found = source_divergence.audit(spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING, source STRING, digest LONG, item STRING"))
    assert found.collect() == []
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]


def brute_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text)."""
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
    found = [(i, Counter(words(text))) for i, text in docs]
    found = [(i, c, c.total()) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 10 + (90 * n * n_docs) // n_terms
            score = 0
            for t in set(words(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k])]
    return out


def same(a, b):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(a, key=key) == sorted(b, key=key)


@pytest.fixture(scope="module")
def library(prose):
    rng = random.Random(9)
    docs = [(i, prose(i % 250, rng.randint(1, 150))) for i in range(400)]  # many equal texts: ties in score
    docs += [(1000 + i, prose(9000, 40) + prose(i, 5)) for i in range(15)]
    docs += [(None, prose(3, 50)), (None, None), (2000, ""), (2001, "!!! ---"), (3, prose(3, 50)), (2002, "Ångström 42 42 straße")]
    items = [(f"i{i}", prose(3000 + i, rng.randint(3, 40))) for i in range(12)]
    items += [("planted", prose(9000, 40)), ("none", None), ("empty", ""), ("unknown", "zzzzqqq xxyyzz"), ("digits", "42 ÅNGSTRÖM ångström"), ("common", "the of stone")]
    return docs, items


@pytest.mark.parametrize(("postings", "query_bytes", "first"), [(1_500_000, 32 << 20, 16), (900, 300, 1), (20_000, 32 << 20, 3)])
def test_search_equals_brute_force(spark, library, monkeypatch, postings, query_bytes, first):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(ranked_search, "FIRST_READ", first)
    docs, items = library
    found = ranked_search.search(
        spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(3), spark.createDataFrame(items, "item_id STRING, text STRING")
    )
    got = [tuple(r) for r in found.collect()]
    expected = brute_search(docs, items)
    assert len({r[0] for r in expected}) == 15
    assert same(got, expected)


def test_search_stops_above_unseen_documents_but_not_at_equal_scores():
    """Ten documents far ahead end the search early; with equal scores below the top it goes on to the least id."""
    n = 20_000
    impact = np.concatenate([np.full(10, 900), np.full(n - 10, 5)])
    term = np.tile([0, 1, 2], n)
    shard = ranked_search.Shard(term, np.repeat(impact, 3), np.arange(0, 3 * n + 1, 3), 3)
    ids, local = np.arange(n)[::-1].copy(), np.full(3, -1)
    docs, scores, looked_up = shard.best(np.array([0, 1, 2]), ids, 1, 10, local)
    assert sorted(docs[np.argsort(-scores)[:10]]) == list(range(10))
    assert looked_up < 100
    docs, scores, looked_up = shard.best(np.array([0, 1, 2]), ids, 1, 11, local)
    assert looked_up == n  # the eleventh is one of many with the same score: the last row has the least id
    assert ids[docs[np.lexsort((ids[docs], -scores))[10]]] == 0
    assert (local == -1).all()


def test_best_positions_stop_before_last_read_positions_would():
    """Documents seen through one list fill the top of the other: their positions count without being read."""
    n = 4000
    rng = np.random.default_rng(4)
    first = np.sort(rng.integers(1, 1000, n))[::-1]
    second = np.empty(n, np.int64)
    second[:200] = np.sort(rng.integers(900, 1000, 200))  # the top of the second list, in the reverse order of the first
    second[200:] = rng.integers(1, 20, n - 200)
    impact = np.stack([first, second], axis=1).ravel()
    shard = ranked_search.Shard(np.tile([0, 1], n), impact, np.arange(0, 2 * n + 1, 2), 2)
    _, scores, looked_up = shard.best(np.array([0, 1]), np.arange(n), 1, 10, np.full(2, -1))
    assert sorted(scores)[-10:] == sorted(first + second)[-10:]
    assert looked_up < n // 4


def test_search_of_odd_and_empty_tables(spark, odd_documents):
    items = spark.createDataFrame([(1, "river stone 日本語テキスト", 5), (None, "abcdef123456", 6), (1, "river stone 日本語テキスト", 7)], "item_id LONG, text STRING, query LONG")
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = [tuple(r) for r in ranked_search.search(odd_documents, items).collect()]
    assert same(got, brute_search(docs, [(r.item_id, r.text) for r in items.collect()]))
    assert ranked_search.search(odd_documents.limit(0), items).collect() == []
    assert ranked_search.search(odd_documents, items.limit(0)).collect() == []
