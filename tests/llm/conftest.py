import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A DataFrame of documents from texts; ids are positions unless given."""

    def make(texts, ids=None, extra=()):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or ""), *(0 for _ in extra)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCS + "".join(f", {e} int" for e in extra))

    return make


#: Texts with what tends to break: nothing, nulls, blanks of all kinds, marks, a long one, repeated ones.
ODD = ["", None, " ", "\n\n  a", "A b  c", "x \n\ny z", "Zoë  ça va\tnaïve\r\n", "don't  STOP 123 !?", "<|endoftext|> x", "café ́x", "a" * 5000, "word " * 3000, "same Text", "SAME text", "same Text", "日本語 テキスト　です", "\x85x \x1c y", "Kİ K"]
