import pytest

from tidemark.llm.shared import workers_import

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, match string, score string, predicted string, "
    "n_lines string, _at string, _id string, size string"
)


def words(n, seed=1):
    """Distinct made-up words."""
    return [f"w{(i * 7919 + seed * 104729) % 1000003}" for i in range(n)]


@pytest.fixture(autouse=True)
def ready(spark):
    workers_import(spark)


@pytest.fixture
def table_of(spark):
    """A documents table of (doc_id, text[, source]) rows, with columns whose names clash with those of operators."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text = row[:2]
            source = row[2] if len(row) > 2 else "a"
            full.append((doc_id, text, "en", source, None if text is None else len(text), *["x"] * 7))
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls, empty texts, white space, repeated rows, non-ASCII and a long text.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\r "),
    (4, "One two three"),
    (4, "One two three"),
    (5, "Éa ñ ÜBER, über!! ☃ \U0001f600 x́"),
    (None, "no id here"),
    (6, " ".join(words(60_000))),
    (7, "a\n\nb\n"),
]
