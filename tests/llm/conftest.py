import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (text, lang, source) rows, with ids from 0."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            text, lang, source = r if isinstance(r, tuple) else (r, "en", "a")
            full.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, TEXT_SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The given small documents, as a function of the table's name."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
