from __future__ import annotations

import random

import pytest

#: Syllables of the invented words of the small corpora.
SYLLABLES = "ka lo mi ren tas vor el and ish der une qua pol wex dru".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.choice((1, 2, 2, 3)))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out = words(rng, n)
    for i in range(0, n, 11):
        out[i] = out[i].capitalize()
        if i:
            out[i - 1] += "."
    return " ".join(out) + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and very long texts, ties, repeated rows, and columns named as results are."""
    rng = random.Random(7)
    long = prose(rng, 30_000)
    some = prose(rng, 120)
    rows = [(1, None, "xx", 1, "a"), (2, "", "xx", 2, None), (3, " \n\t ", None, 3, "b"), (4, long, "xx", 4, "c"),
            (5, some, "xx", 5, "d"), (5, some, "xx", 5, "d"), (6, some, "yy", 6, "e"), (None, "Odd one", "xx", 7, "f"),
            (None, None, None, None, None), (8, "🙂 ünïcode <|endoftext|> 'tis ½ x y", "xx", 8, "g")]
    rows += [(20 + i, prose(rng, 80), "xx", i, "h") for i in range(8)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n_words long, `row` string") \
        .selectExpr("*", "doc_id as fp", "n_words as ids", "lang as source", "n_words as score", "lang as good")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
