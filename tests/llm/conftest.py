import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column whose names clash with internal ones."""

    def make(rows):
        data = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows]
        return spark.createDataFrame(data, DOCS + ", row_key int, digest string").repartition(3)

    return make
