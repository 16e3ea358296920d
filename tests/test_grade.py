"""Golden rows for the graders."""

import random

from pyspark.sql import functions as F

from gradeloom.functions import grade as G
from gradeloom.functions import latex

PAIR = ("a", "b")


def test_same_answer(evaluate):
    rows = [(None, None), ("A", "A"), ("A", None), ("A", "B")]
    assert evaluate(G.same_answer, rows, PAIR) == [True, True, False, False]
    strict = evaluate(lambda g, p: G.same_answer(g, p, False), rows, PAIR)
    assert strict == [False, True, False, False]
    by_value = lambda g, p: G.same_answer(g.cast("bigint"), p.cast("double"))
    assert evaluate(by_value, [("3", "3.0"), ("3", "3.75")], PAIR) == [True, False]


def test_guesses(evaluate):
    rows = [("C", None, "3"), ("A", None, "4"), ("C", None, "4"), ("B", "B", "4"), ("A", None, "9"), ("A", "", "2")]
    grade = lambda g, p, n: G.choice_correct(g, p, n.cast("int"))
    assert evaluate(grade, rows, ("g", "p", "n")) == [True, True, False, True, False, True]
    none = lambda g, p, n: G.choice_correct(g, p, n.cast("int"), guess=False)
    assert evaluate(none, rows, ("g", "p", "n")) == [False, False, False, True, False, False]


def test_numbers(evaluate):
    rows = ["1_000", "1d", "1,000", "nan", " 5 ", "1e3", ".5", "5.", "1__0", "", "-inf", "0x1", "+3"]
    want = [True, False, True, True, True, True, True, True, False, False, True, False, True]
    assert evaluate(G.is_number, rows) == want
    assert evaluate(G.as_number, ["1_000", "1,000.5", "x", " 2 "]) == [1000.0, 1000.5, None, 2.0]


def test_numbers_agree(evaluate):
    rows = [
        ("50", "0.5"), ("100", "100.005"), ("100", "100.02"), ("nan", "nan"), ("inf", "inf"),
        ("inf", "5"), ("0", "0"), ("0", "1e-9"), ("1e308", "1e308"),
    ]
    got = evaluate(lambda a, b: G.numbers_agree(a.cast("double"), b.cast("double")), rows, PAIR)
    assert got == [True, True, False, False, True, False, True, False, True]
    exact = evaluate(
        lambda a, b: G.numbers_agree(a.cast("double"), b.cast("double"), percent=False), rows[:2], PAIR
    )
    assert exact == [False, True]


def test_brackets_and_tuples(evaluate):
    rows = [("(1, 2)", "1, 2"), ("[1,2]", "(1,2)"), ("{1}", "1"), ("[a]", "a")]
    assert evaluate(G.same_without_brackets, rows, PAIR) == [True, False, True, True]
    rows = [("(1.0,2)", "(1,2.0)"), ("[(1.0)]", "[(1)]"), ("(1,2)", "(1,2,3)"), ("", ""), ("()", "(1)")]
    assert evaluate(G.answers_equal, rows, PAIR) == [True, True, False, False, False]
    deep = [
        ("(((1.0)))", "(((1)))"), ("[[[[1.0]]]]", "[[[[1]]]]"), ("((((2))))", "((((1))))"), ("(((1.0)),2)", "(((1)),2.0)"),
        ("(" * 40 + "1.0" + ")" * 40, "(" * 40 + "1" + ")" * 40), ("(((1.0))", "(((1))"),
    ]
    assert evaluate(G.answers_equal, deep, PAIR) == [True, True, False, True, True, False]


def test_latex_equal(evaluate):
    cases = {
        ("\\frac12", "\\frac{1}{2}"): True,
        ("0.5", "1/2"): True,
        ("x=5", "5"): True,
        ("", ""): True,
        (None, ""): False,
        (None, None): True,
        ("5\\text{ cm}", "5"): True,
        ("nan", "nan"): True,
        ("2\\sqrt", "2\\sqrt"): True,
        ("100", "100.02"): False,
        ("50", "0.5"): False,
        ("10\\%", "10"): True,
        ("\\$5", "5"): True,
    }
    assert evaluate(G.latex_equal, list(cases), PAIR) == list(cases.values())


def test_latex_flags(evaluate):
    rows = [("2\\sqrt", "2"), ("x+1", "1+x"), ("3", "4"), ("5\\text{ a}\\text{ b}", "5"), ("\\frac", "1"), (None, "1")]
    got = [r.asDict() for r in evaluate(G.latex_verdict, rows, PAIR)]
    assert [r["raw_compared"] for r in got] == [True, False, False, True, True, False]
    assert [r["needs_symbolic"] for r in got] == [True, True, False, True, True, False]
    assert not any(r["correct"] for r in got)


def test_normal_forms(evaluate):
    cases = {
        "\\tfrac{1}{2}": "\\frac{1}{2}",
        "\\dfrac12": "\\frac{1}{2}",
        "\\frac1{72}": "\\frac{1}{72}",
        "\\frac{1}2": "\\frac{1}2",
        "\\frac1": "\\frac1",
        "\\frac1\\frac23": "\\frac1\\frac23",
        "\\frac123+\\frac45": "\\frac{1}{2}3+\\frac{4}{5}",
        "\\sqrt2": "\\sqrt{2}",
        "\\sqrt 2": "\\sqrt{}2",
        "\\sqrt\\pi": "\\sqrt{\\}pi",
        "3/4": "\\frac{3}{4}",
        "03/4": "03/4",
        "-3/4": "\\frac{-3}{4}",
        "3/4/5": "3/4/5",
        "a/b": "a/b",
        " .5": "\\frac{1}{2}",
        "{.5}": "{0.5}",
        ".25": "0.25",
        "k = 7": "7",
        "abc=7": "abc=7",
        "a=b=c": "a=b=c",
        "\\left(1,\\, 2\\right)": "(1,\\,2)",
        "90^\\circ": "90",
        "a\\\\b\\!c": "a\\bc",
        "1\n2": "12",
        "50\\\\%": "50",
    }
    assert evaluate(latex.normalize, list(cases)) == list(cases.values())


def test_commands(evaluate):
    rows = [('{"a":1}', '{"a":1}'), ('{"a":"22"}', '{"a":22}'), ("null", "null"), (None, None), ('"x"', '"x"')]
    assert evaluate(G.command_correct, rows, PAIR) == [True, False, False, False, True]


def test_rewards_and_verdicts(evaluate):
    truth = lambda a: G.reward(a.cast("boolean"))
    assert evaluate(truth, ["true", "false", None]) == [1.0, -1.0, -1.0]
    rows = [("pass", "pass"), ("pass", "fail"), ("fail", "pass"), (None, "pass")]
    assert evaluate(G.plus_passed, rows, PAIR) == [True, False, False, False]


def test_language_gate(evaluate):
    rows = [("true", "0.6"), ("true", "0.5"), ("false", "0.9"), ("true", None)]
    gate = lambda c, p: G.in_language(c.cast("boolean"), p.cast("double"))
    assert evaluate(gate, rows, PAIR) == [True, False, False, False]


def test_random_texts_never_fail(evaluate):
    rng = random.Random(3)
    parts = list("A0123456789.,{}\\()[]/= ") + ["\\boxed", "\\frac", "\\sqrt", "\\text{ ", "nan", "e"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(600)]
    pairs = list(zip(texts[::2], texts[1::2])) + [(t, t) for t in texts[:100]]
    got = evaluate(G.latex_equal, pairs, PAIR)
    assert all(isinstance(v, bool) for v in got)
    # A text equals itself, whether it has a normal form, is a number or neither.
    assert all(got[300:])


def test_symmetry_of_column_expressions(spark):
    """The same verdicts from one and from seven partitions."""
    rows = [(f"{i % 7}/{i % 5 + 1}", f"\\frac{{{i % 7}}}{{{i % 4 + 1}}}") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, p string")
    verdicts = [
        sorted(df.repartition(n).select("g", "p", G.latex_equal(F.col("g"), F.col("p"))).collect())
        for n in (1, 7)
    ]
    assert verdicts[0] == verdicts[1]
