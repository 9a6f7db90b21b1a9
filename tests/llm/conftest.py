import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, gone string, slot string, n int, rid long, m_doc long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1, "x", "y", 7, 8, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    long = "wörd Another, word. <|endoftext|> it's 12 " * 1500
    return [(1, "hello there, World"), (2, None), (3, ""), (4, "  \n\t "), (None, "null id"), (5, long), (6, "hello there, World"), (6, "hello there, World"), (7, "日本語 текст 🙂. é")]
