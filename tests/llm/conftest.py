import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with the columns of the table and a column whose name an operator could want to use."""

    def make(texts, start=0, ids=None, **extra):
        ids = ids if ids is not None else range(start, start + len(texts))
        rows = [(i, t, "en", "s", None if t is None else len(t), 1.0) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity double")

    return make
