import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table from (doc_id, text[, lang]) tuples, dealt over several partitions."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return make


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
ODD_ROWS = [
    (None, "no id but some words here to read"),
    (1, None),
    (2, ""),
    (3, " \t\n \r\n"),
    (4, "one"),
    (5, "two words"),
    (6, "…§¶ ‑‑ ★"),
    (7, LONG),
    (8, "same row"),
    (8, "same row"),
    (9, "same id first text"),
    (9, "same id other text"),
]


@pytest.fixture
def odd(documents_of):
    """Null ids and texts, empty, blank, short and very long texts, repeated ids and rows."""
    return documents_of(ODD_ROWS)


@pytest.fixture
def empty(documents_of):
    return documents_of([])
