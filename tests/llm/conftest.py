import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text) pairs, with columns whose names operators may use inside."""

    def make(pairs, **extra):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", label string, bucket int")

    return make
