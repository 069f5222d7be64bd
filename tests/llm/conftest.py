import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h string, fp string, row string, serial string, score string, `n` int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text), with extra columns whose names clash with the operators' own."""

    def f(rows, lang=None, source=None):
        out = []
        for i, r in enumerate(rows):
            d, t = r if isinstance(r, tuple) else (i, r)
            out.append((d, t, lang[i] if lang else "en", source[i] if source else f"src{i % 3}", len(t) if t else None, "x", "x", "x", None, "x", "x", 1))
        return spark.createDataFrame(out, SCHEMA)

    return f


#: Rows that every operator must take: null, empty, blank, long, repeated, null id, odd characters.
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "Two  words\there."), (6, "Two words here."), (None, "null id text with words"), (None, "null id text with words"), (7, "word " * 30000), (8, "日本語 é　全角 ÀÉ \x1c 😀 'S <|endoftext|> x"), (9, "\x00" * 3), (10, None)]


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def none(make, edges):
    return edges.limit(0)
