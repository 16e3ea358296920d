"""Cleaning generated code: one golden row per rule."""

import pytest

from gradeloom.operators.code import clean_code, parses

CASES = {
    "text\n```python\ndef f(a):\n    return a\n```\nmore": "def f(a):\n    return a",
    "```\ndef g():\n    return 1\n```\nx\n```\ndef f():\n    return 2\n```": "def f():\n    return 2",
    # A body without an indented return is no body.
    "def f(a):\n    print(a)": "",
    "import os\ndef f(a):\n    pass": "import os",
    # Lines indented by three characters get a fourth.
    "def f(a):\n   if a:\n    return a": "def f(a):\n    if a:\n    return a",
    # Unindented lines go, imports and definitions stay, a script ends it.
    "def f(a):\n    return a\nx = 1\nimport re\n    # tail\nif x:\n    y()\n": "def f(a):\n    return a\nimport re\n    # tail",
    'def f(a):\n    return a\n"""doc"""\n    z': "def f(a):\n    return a",
    "def f(a):\n    return a\n\nprint(f(1))\nimport os": "def f(a):\n    return a",
    # Helpers that do not parse go, the wanted function stays whatever it is.
    "def h(x):\n    return x\ndef bad(:\n    return 0\ndef f(a):\n    return h(a": "def h(x):\n    return x\ndef f(a):\n    return h(a",
    "def f (a):\r\n    return a": "def f(a):\n    return a",
    # Two versions of the function: both bodies that return are kept.
    "def f(a):\n    return 1\ndef f(a):\n    return 2": "def f(a):\n    return 1\ndef f(a):\n    return 2",
    "no code": "no code",
    "": "",
    "def ff(a):\n    return 1": "def ff(a):\n    return 1",
    "def f(a):\n    return a\n<stop>\n    junk": "def f(a):\n    return a",
}


def test_clean_code(spark):
    rows = [(i, "f", code) for i, code in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, entry string, code string").repartition(3)
    got = clean_code(df, "code", "entry", eofs=["\n<stop>"]).orderBy("n").collect()
    for row, (code, want) in zip(got, CASES.items()):
        assert row.cleaned == want, code


def test_names_are_no_patterns(spark):
    df = spark.createDataFrame([("a.b", "def a.b(x):\n    return x"), ("a.b", "def axb(x):\n    return x")], "e string, c string")
    got = [r.cleaned for r in clean_code(df, "c", "e").collect()]
    # The first one is found by its name; "axb" is a helper that parses.
    assert got == ["def a.b(x):\n    return x", "def axb(x):\n    return x"]


def test_dropped_prefix_lines(spark):
    df = spark.createDataFrame([("f", "# x\ndef f(a):\n    return a\n# y")], "e string, c string")
    assert clean_code(df, "c", "e", drop_prefix="#").first().cleaned == "def f(a):\n    return a"


@pytest.mark.parametrize(
    "code, valid", [("x = 1", True), ("def f(:", False), ("x = 1\x00", False), (None, False), ("", True)]
)
def test_parses(spark, code, valid):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(parses("c").alias("v")).first().v is valid
