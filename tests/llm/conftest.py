import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tmp_0 string, TMP_1 int, m string, digest string, n_words string, kept string, component_id string, ids string, label int, window string"
EXTRA = ("x", 1, "m", "d", "w", "k", "c", "i", 0, "v")


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(("the", "of", "river", "and", "stone", "winter", "green", "walk", "house", "letter", "cloud", "small", "under", "glass")) + rng.choice(("", "s", "ly", "ing", str(rng.randrange(60)))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, one word, a very long text, ties, repeated rows, many scripts."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    plain = prose(rng, 60)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\v\f\r "),
        (4, "word"),
        (5, "word"),
        (6, "three words here"),
        (7, long),
        (8, long + " and a little more"),
        (9, plain),
        (9, plain),
        (10, plain),
        (None, plain),
        (None, None),
        (11, "ß İ ΣΑΣ ñandú 日本語 ☃ \0 \x1c a b ▁ ▁▁x  y"),
        (12, "x" * 5_000),
        (13, "no\n\nno\nno\nno"),
        (-4, "mail a.b@c.de, +1 (017) 555-7713, 97.51.17.173 and 4111 1111 1111 1111"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as a table with more columns, whose names operators might use themselves."""
    rows = [(i, t, None, None, None if t is None else len(t), *EXTRA) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
