import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, node string, "
          "kept string, rank int, row string")


@pytest.fixture
def documents(spark):
    """A documents table with extra columns whose names operators may use themselves."""
    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "s", "n", "k", 1, "r") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make
