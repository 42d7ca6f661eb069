import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) rows, with a clashing and an extra column."""

    def make(rows, **more):
        data = [(i, t, more.get("lang", "en"), f"src{k % 3}", None if t is None else len(t), "x", 1.5) for k, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, line string, score double"
        return spark.createDataFrame(data, schema).repartition(3)

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
