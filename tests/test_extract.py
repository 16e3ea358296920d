"""Golden rows and random texts for the extractors."""

import random
import re

from pyspark.sql import functions as F

from gradeloom.functions import extract as E


def test_last_number(evaluate):
    rows = ["#### 1,234", "-5", "3.14.15", "7.", "none", "..5", "v1.2b", "1 2 3", "", "٣"]
    want = [234.0, 5.0, 0.15, 7.0, None, 0.5, 1.2, 3.0, None, None]
    assert evaluate(E.last_number, rows) == want


def test_last_number_strict(evaluate):
    rows = ["#### 1,234", "is -5", "x 1,234,567.5 y", "none"]
    got = evaluate(lambda t: E.last_number(t, "strict"), rows)
    assert got == [1234.0, -5.0, 1234567.5, None]


def test_last_option_letter(evaluate):
    rows = ["B, so the answer is (C). Done", "because b", "A\nB\nx", None]
    assert evaluate(E.last_option_letter, rows) == ["D", None, "B", None]


def test_choice_letter(evaluate):
    cases = {
        "the answer is (C), not D": "C",
        "Answer: A or Answer: B": "B",
        "Answer: A\nAnswer: B": "A",
        "Answer: A\rAnswer: B": "B",
        "maybe A, then F": "F",
        "no letter": None,
        "answer:\n\n  J": "J",
        "éA Bé C_": None,
        "A": "A",
        "K then L": None,
    }
    assert evaluate(E.choice_letter, list(cases)) == list(cases.values())


def test_boxes(evaluate):
    first = {"\\boxed{code} \\boxed{math}": "code", "\\boxed{}": "", "boxed{x}": None, "\\boxed{a\nb}": "a\nb"}
    assert evaluate(E.first_box, list(first)) == list(first.values())
    last = {
        "x \\boxed{a{b}c} t": "a{b}c",
        "\\boxed{a": None,
        "\\fbox{2}": None,
        "\\boxed{1} \\fbox{2}": "1",
        "\\boxed {1}": None,
        "\\boxed{}": "",
        "\\boxed}{{x}}": None,
        "\\boxed{1} and \\boxed{2": None,
    }
    assert evaluate(E.last_balanced_box, list(last)) == list(last.values())


def test_final_answer(evaluate):
    cases = {
        "The answer is: 5.\nx": "5",
        "The answer is: 5. The answer is: 6.": "6",
        "The answer is:  7 .": "7",
        "so \\boxed{8}": "8",
        "The answer is: ": "",
        "nothing": None,
    }
    assert evaluate(E.final_answer, list(cases)) == list(cases.values())


def test_json_command(evaluate):
    cases = {
        '{"command":{"a":1,"b":"2"}}': '{"a":1,"b":"2"}',
        "[1]": None,
        "oops": None,
        '{"command":null}': "null",
        '{"command":{"b":1.0,"a":[2,1]}}': '{"a":[2,1],"b":1}',
        "3": None,
    }
    assert evaluate(E.json_command, list(cases)) == list(cases.values())
    assert evaluate(E.malformed_json, ["oops", "{}", None]) == [True, False, False]


def test_fence_parts(evaluate):
    rows = ["abcdef", "x = 1\n```\n why \n", "```a```b"]
    assert evaluate(E.completion_body, rows) == ["abcdef", "x = 1\n", ""]
    assert evaluate(E.explanation, rows) == ["cdef", "why", "a```b"]


def test_labels_and_stops(evaluate):
    assert evaluate(E.expert_label, ["code", "Code", None, "math "]) == ["code"] + ["other"] * 3
    cut = evaluate(lambda t: E.cut_at_stops(t, ["ab", "ba"]), ["xaba", "no", "ba"])
    assert cut == ["x", "no", ""]


WORDS = list("ABCDEFGHIJ0123456789.,{}\\()[] \n") + ["\\boxed", "\\fbox", "answer is ", "Answer: ", "The answer is: "]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(0, 60))) for _ in range(n)]


def _balanced(text):
    if "\\boxed" not in text:
        return None
    tail = text[text.rindex("\\boxed") + 6 :]
    depth = 0
    for i, char in enumerate(tail):
        depth += (char == "{") - (char == "}")
        if char == "}" and depth == 0:
            return tail[1:i] if tail[0] == "{" else None
    return None


def test_random_texts(evaluate):
    texts = _texts(400, 1)
    numbers = [re.findall(r"\d*\.?\d+", t) for t in texts]
    assert evaluate(E.last_number, texts) == [float(n[-1]) if n else None for n in numbers]
    letters = [[c for c in t if c in "ABCDE"] for t in texts]
    assert evaluate(E.last_option_letter, texts) == [c[-1] if c else None for c in letters]
    assert evaluate(E.last_balanced_box, texts) == [_balanced(t) for t in texts]
    boxes = [re.search(r"\\boxed{([^}]*)}", t) for t in texts]
    assert evaluate(E.first_box, texts) == [b and b[1] for b in boxes]


def test_long_text_without_hits_is_fast(spark):
    """Patterns for the last hit are anchored: no quadratic search on long texts."""
    df = spark.range(20).select(F.expr("repeat('xy ', 100000)").alias("t"))
    row = df.agg(
        F.count(E.last_number(F.col("t"))), F.count(E.choice_letter(F.col("t")))
    ).first()
    assert tuple(row) == (0, 0)
