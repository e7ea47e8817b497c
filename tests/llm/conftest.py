"""Small documents with the awkward cases: nulls anywhere, empty, wordless and long texts, repeated rows, shared ids, and
extra columns whose names the operators use themselves."""

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven grey whales swim slowly past an empty harbour".split()


def text(n, step=1, start=0):
    return " ".join(WORDS[(start + i * step) % len(WORDS)] + ("." if i % 11 == 10 else "") for i in range(n))


ROWS = [
    (1, text(60), "en", "a"), (2, text(60), "en", "a"), (3, None, "en", "a"), (4, "", "en", None), (5, " \n\t ", None, "b"),
    (6, "one two", "en", "b"), (7, "ONE two", "de", "b"), (8, text(4000, 3, 5) + "\n" + text(50, 5), "de", "a"), (9, "Zoë läuft — 3 × ½\n" * 12, "de", "a"),
    (9, "Zoë läuft — 3 × ½\n" * 12, "de", "a"), (10, text(60) + " extra words", "en", "c"), (None, text(80, 7), "en", "c"), (None, None, None, None),
    (11, "x y z " * 40 + "\n\n a  b", "en", "c"), (12, "4711 $$$ ###", "en", "c"), (12, "another text under the same id", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows, with columns of other names that the operators use inside."""
    extra = [(*r, "x", 0.5, 7, True) for r in ROWS]
    return spark.createDataFrame(extra, SCHEMA + ", body string, score double, n_words int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return ROWS
