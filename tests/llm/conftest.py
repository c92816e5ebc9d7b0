import pytest

#: Null, empty, blank, repeated and odd texts; ids repeat too.
EDGE_TEXTS = [None, "", " \n\t ", "one", "one two", "one two three", "one two three", "é ü 漢字 😀 x", "a" * 5000, "word " * 3000, "line\nline\nline\nline\n\n", "\x00 odd\x0bspace\x0cform\rfeed"]


@pytest.fixture()
def edge_docs(spark):
    rows = [(i, t, "en", "src0" if i % 3 else None, len(t or "")) for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
