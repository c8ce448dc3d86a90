import random

import pytest

WORDS = "the of stone river lantern quiet walked across bright harbour seven copper morning letters garden under while carried every window".split()


@pytest.fixture(scope="session")
def prose():
    """``prose(seed, n)``: n words of invented text with marks, capitals and line ends."""

    def make(seed, n):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            word = rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("abdeilmnorstuüéñ") for _ in range(rng.randint(2, 9)))
            out.append(word.capitalize() if i % 11 == 0 else word)
            out.append(rng.choice([" ", " ", " ", ", ", ". ", ".\n", "  ", "\t"]))
        return "".join(out)

    return make


@pytest.fixture(scope="session")
def odd_documents(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (7, prose(1, 300), "en", "a", 1),
        (7, prose(1, 300), "en", "a", 1),
        (7, prose(2, 40), "de", "b", None),
        (None, prose(3, 60), None, None, None),
        (None, None, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "fr", "a", 0),
        (5, " \n\t ", "fr", "a", 4),
        (-2, "Naïve café   日本語テキスト кириллица 🙂🙂 école", "fr", "c", 30),
        (9, prose(4, 60_000), "en", "a", None),
        (10, "x" * 70_000, "en", "a", 70_000),
        (11, "<|endoftext|> token: abcdef123456 <|startoftext|>", "en", "a", 40),
        (12, "'s don't we'LL 12345 a,b.c!d?e;f:g", "en", "a", 40),
    ]
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    docs = spark.createDataFrame(rows, schema)
    more = "1 AS doc, 2 AS kept, 3 AS hits, 4 AS ids, 5 AS n_words, 6 AS node, 7 AS items, 8 AS score, 9 AS part, 10 AS line"
    return docs.selectExpr("*", *more.split(", "))
