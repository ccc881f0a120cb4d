import pytest

#: Texts for the edges: null, empty, blanks, ties, repeated rows, other scripts, special strings, one long.
EDGE_TEXTS = [None, "", " ", "  two  spaces ", "a", "a", "The end.\nNext line's here", "İstanbul ΣΑΣ ς é 中文 \U0001f600", "x<|endoftext|>y <|startoftext|>", "tab\tand nbsp \x1c sep", "don't WE'LL 12345 ½ ___ --- !!!", "word " * 5000, "é" * 300]

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, length string, p int, key string, file string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if t is None else len(t), "x", "y", None, None, "f") for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id", None, None, None, None, None, None, None, None)], DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
