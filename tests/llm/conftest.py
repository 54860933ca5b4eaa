import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from texts or (doc_id, text) pairs."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(full, DOCS)

    return make
