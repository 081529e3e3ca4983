import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table from (doc_id, text) pairs, with columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "x", 1.0) for i, t in rows], "doc_id long, text string, lang string, n string, label double")

    return make
