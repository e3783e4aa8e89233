"""Small tables that hold what operators must cope with."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, node long"
LONG = " ".join(f"word{i}" for i in range(20_000))


def rows():
    text = "one two three four five six seven eight nine ten eleven twelve"
    lines = "alpha beta\ngamma delta\nepsilon zeta\neta theta"
    return [
        (1, text),
        (2, text),
        (2, text),  # a repeated row
        (3, None),
        (4, ""),
        (5, "   "),
        (6, lines),
        (7, "intro\n" + lines + "\noutro"),
        (8, LONG),
        (9, LONG + " tail"),
        (None, "text without an id"),
        (None, None),
        (10, "solo"),
        (11, "ünïcödé wörds ß 中文 \U0001f600 and more"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("en", "src", 1, 0.5, "clash", 7)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows()], COLUMNS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def workspace(spark):
    from pseudospark.sources.files import Workspace

    return Workspace(spark)
