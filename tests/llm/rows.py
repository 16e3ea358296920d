"""Rows at the edge of what the operators are given, as fixtures."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, "
    "_text string, _key long, n_words string, row int, new int, _kept string"
)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and white texts, repeats, ties, signs, other scripts, one very long text."""
    line = "The and attion to thanedble the anea eriner of thon whand"
    return [
        None,
        "",
        " \t\r\n\n",
        "word",
        "four words are here",
        line,
        line,
        line.upper(),
        f"{line}\n{line}\nanother line here\n{line} and more words to come\nlast line",
        "1 2 3 \x00 $$$ été 漢字 \U0001f600 naïve <|endoftext|> İstanbul",
        "\n".join(f"{line} number {i} and {i * 7} of {i % 13}" for i in range(3000)),
        "a " * 5000,
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with columns whose names the operators use inside; one row twice."""
    rows = [
        (i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 0.5, "r", "t", 1, "w", 2, 3, "k")
        for i, t in enumerate(odd_texts)
    ]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
