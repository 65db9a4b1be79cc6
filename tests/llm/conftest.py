import pytest

from quillgraph.llm.common import for_python


@pytest.fixture(autouse=True)
def ready(spark):
    for_python(spark)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _key string, bucket int, key string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, an empty and a very long text, ties and repeated rows, and columns with clashing names."""
    long = "word " * 30_000 + "password=abcdef123"
    rows = [(1, None), (2, ""), (3, long), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, " \n\t"), (7, "é ² 日本 \x1c x"), (8, "same id one"), (8, "same id two")]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in (2, 5) else "s", None, "k", 7, None) for i, t in rows], ODD)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ODD)
