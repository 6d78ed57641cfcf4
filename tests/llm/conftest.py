import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp string, size string, target string, line string, th string, bits string, places string, verdict string, a string"
)
CLASH = ("x",) * 9


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", len(t or ""), *CLASH) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Texts to a table of documents with columns whose names clash with the operators' own."""

    def make(texts, start=0):
        return spark.createDataFrame(rows_of(texts, start), SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnoprstuvwéß", k=rnd.randint(2, 9))) for _ in range(400)]

    def make(n, seed):
        return " ".join(random.Random(seed).choices(vocabulary, k=n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names."""
    long = "\n".join(words(40, i) for i in range(400))
    rows = rows_of([None, "", " \n\t ", "one", words(80, 1), words(80, 1), long, "a" * 3000, "é\n" * 30, words(60, 2)])
    rows += [rows[4], rows[4], rows[9], (None, words(80, 1), None, None, None, *CLASH), (None, None, None, None, None, *(None,) * 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
