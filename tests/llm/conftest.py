import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, langs=None, ids=None, **extra):
        rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
