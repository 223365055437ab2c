import pytest

NASTY_TEXTS = [
    None, "", " ", "\n", "\n\n", "word", "two words", " \t\x0b\x0c\r\n ", "é漢 ß", "a" * 5000, "x y " * 3000, "\x00", "\x1c \x85　",
    "Line of some length\nline of SOME length \nother", "Line of some length", "same text here again and again", "same text here again and again",
]


@pytest.fixture
def nasty(spark):
    """Documents with nulls everywhere, odd texts, repeated rows and columns named like the operators' own."""
    rows = [(i if i % 5 else None, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 7, 1, "x") for i, t in enumerate(NASTY_TEXTS)]
    rows += [rows[-1], rows[-1], rows[3]]
    schema = "doc_id long, text string, lang string, source string, size int, h1 int, component_id string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def empty(nasty):
    return nasty.limit(0)
