import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _key string, hi long, which int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with further columns whose names clash with inner ones."""

    def of(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, "k", 1, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return of
