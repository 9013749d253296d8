import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with the other columns null."""

    def make(pairs):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and white texts, repeated rows, equal ids, one very long text."""
    long = " ".join(f"word{i % 997} x{i}" for i in range(60_000))
    return make_docs(
        [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "Grüße, Welt! 　 é"), (None, "no id at all"), (None, None), (6, long), (6, "another text")]
    )


@pytest.fixture(scope="session")
def crowded_names(spark):
    """A table whose other columns have the names that the operators use inside."""
    rows = [(k, f"text number {k} of the table", *([k] * 16)) for k in range(5)]
    names = "id t fp key h rid keys row place _rid _hash _keys _ranges _h _fp _more".split()
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def sample():
    """Texts of the smallest table."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
