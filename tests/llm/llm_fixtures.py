import pytest

from tallyframe.llm.base import prepare


@pytest.fixture(scope="session")
def ls(spark):
    return prepare(spark)


ODD = [
    (0, None),
    (1, ""),
    (2, " \t\n\r\x0b\x0c "),
    (3, "a"),
    (4, "One two, three."),
    (4, "One two, three."),
    (5, "éè中文\U0001f600 tail"),
    (6, "x" * 70000),
    (7, "wörd " * 9000),
    (None, "no key here at all, only words and words"),
]


@pytest.fixture(scope="session")
def odd(ls):
    """Nulls, empty and long texts, ties and repeated rows, and clashing extra columns."""
    rows = [(i, t, "en" if i and i % 2 else None, "s", 1.5, "x") for i, t in ODD]
    return ls.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept string")
