import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, batch string, head string, key string"


def row(doc_id, text, lang="en", source="s"):
    """With extra columns whose names clash with those that operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), -1, "extra", "extra", "extra", "extra")


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], SCHEMA)


LINE = "This line is the same in many documents."
LONG = "Every good story begins somewhere near the middle, and this one is no exception to that old rule of thumb. " * 5


@pytest.fixture(scope="session")
def edge(make):
    """Nulls in any column, empty and blank texts, ties, repeated rows, very long texts."""
    return make(
        [
            (1, None, None, None),
            (2, "", None),
            (3, " \t\n\x0b\r\f "),
            (None, "a text without an id, which is about ten words long, or a little more"),
            (5, LINE + "\n" + LINE + "\nsomething else"),
            (6, "x\n  " + LINE.upper() + "\t\ny"),
            (7, "x\n" + LINE),
            (8, LONG),
            (9, LONG),
            (9, LONG),
            (10, "prefix " + LONG + " suffix"),
            (11, "émile Ünïcode 中文 😀 words and \x00 zero"),
            (12, "word " * 20000),
            (13, " ".join(f"w{i * i % 7919}" for i in range(20000))),
            (14, "l\n" * 5000),
        ]
    )
