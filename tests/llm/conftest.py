import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of ``documents`` from (key, text) pairs, with extra columns of clashing names if asked for."""

    def make(rows, **extra):
        data = [(k, t, "en", "src0", None if t is None else len(t), *extra.values()) for k, t in rows]
        schema = DOCUMENTS + "".join(f", {name} {'string' if isinstance(v, str) else 'long'}" for name, v in extra.items())
        return spark.createDataFrame(data, schema)

    return make
