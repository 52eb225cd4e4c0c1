import pytest


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    from tessera.llm.common import prepare
    prepare(spark)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing extra columns."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("word7 ", "other "), "en", "b"),
            (4, "", "en", "a"), (5, None, "en", "a"), (6, " \t\n ", None, None), (7, "short text", "de", "a"), (8, "short  text", "de", "a"),
            (9, " ".join(f"long{i}" for i in range(30000)), "en", "a"), (None, base, "en", "a"), (None, None, None, None),
            (10, "12345 ... !!", "fr", "b"), (11, "Çà et là, des élèves", "fr", "b"), (12, "SHORT text", "de", "c"),
            (13, base + " tail one two", "en", "a")]
    rows = [(*r, len(r[1]) if r[1] else 0, f"k{i}", i, -1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, DOCS + ", digest string, id bigint, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
