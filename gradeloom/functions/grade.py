"""Grading: equality, guesses, numbers, LaTeX answers, JSON commands, rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import latex
from gradeloom.functions.text import drop_text, let, strip

# The letter drawn when no answer was extracted, by option count.
GUESS_BY_OPTION_COUNT = {1: "A", 2: "A", 3: "C", 4: "A", 5: "A"}

# Number syntax after commas are removed: digits may be grouped by underscores.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = (
    rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))\z"
)


def same_answer(gold: Column, prediction: Column, null_is_correct: bool = True) -> Column:
    """Plain equality. Two missing answers agree unless told otherwise."""
    if null_is_correct:
        return gold.eqNullSafe(prediction)
    return F.coalesce(gold == prediction, F.lit(False))


def guessed_letter(option_count: Column) -> Column:
    """The constant guess for a number of options, null outside 1 to 5."""
    pairs = [F.lit(x) for kv in GUESS_BY_OPTION_COUNT.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), option_count.cast("int"))


def choice_correct(
    gold: Column, prediction: Column, option_count: Column, guess: bool = True
) -> Column:
    """Equality when something was extracted, else whether the guess hits."""
    said = F.coalesce(prediction == gold, F.lit(False))
    lucky = F.coalesce(guessed_letter(option_count) == gold, F.lit(False))
    missing = prediction.isNull() | (prediction == "")
    return F.when(missing, lucky if guess else F.lit(False)).otherwise(said)


def guess_undefined(prediction: Column, option_count: Column) -> Column:
    """Rows that would need a guess but have no letter to draw."""
    missing = prediction.isNull() | (prediction == "")
    return missing & guessed_letter(option_count).isNull()


def as_number(text: Column) -> Column:
    """The value of a text that reads as a number once commas are gone, else null."""
    return let(
        lambda t: F.when(t.rlike(NUMBER), drop_text(t, "_").try_cast("double")),
        strip(drop_text(text, ",")),
    )


def is_number(text: Column) -> Column:
    return strip(drop_text(text, ",")).rlike(NUMBER)


def is_close(a: Column, b: Column, rel_tol: float = 1e-4) -> Column:
    """Relative closeness; infinities only equal themselves, nan equals nothing."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b))
    return (
        F.when(F.isnan(a) | F.isnan(b), F.lit(False))
        .when(infinite, a == b)
        .otherwise(near)
    )


def numbers_agree(
    value: Column, reference: Column, percent: bool = True, rel_tol: float = 1e-4
) -> Column:
    """Closeness to the reference, or to it read as a percentage either way."""
    if not percent:
        return is_close(reference, value, rel_tol)
    readings = F.array(reference / 100, reference, reference * 100)
    return F.exists(readings, lambda r: is_close(r, value, rel_tol))


def _wrapped(text: Column, left: str, right: str) -> Column:
    return text.startswith(left) & text.endswith(right)


def _bare_equal(a: Column, b: Column) -> Column:
    outer = (_wrapped(a, "[", "]") & ~b.startswith("(")) | (
        _wrapped(a, "(", ")") & ~b.startswith("[")
    )
    sides = F.array(a, b)
    trimmed = F.when(
        outer, F.transform(sides, lambda t: F.btrim(t, F.lit("[]()")))
    ).otherwise(sides)
    bare = F.transform(trimmed, lambda t: F.translate(t, "{}()", ""))
    return let(lambda pair: pair[0] == pair[1], bare)


def same_without_brackets(a: Column, b: Column) -> Column:
    """String equality that ignores braces, parentheses and outer brackets."""
    return let(_bare_equal, strip(a), strip(b))


def _parts(text: Column) -> Column:
    return F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",", -1)


def _both_wrapped(a: Column, b: Column) -> Column:
    return (_wrapped(a, "[", "]") & _wrapped(b, "[", "]")) | (
        _wrapped(a, "(", ")") & _wrapped(b, "(", ")")
    )


def answers_equal(
    gold: Column, prediction: Column, percent: bool = True, rel_tol: float = 1e-4
) -> Column:
    """Equality of two non-null answer texts: numbers, brackets, then tuple parts.

    Two numbers are decided by their values alone. Parts of a tuple or interval are
    compared the same way at any depth: a list of undecided pairs starts with the two
    texts, and every step drops the equal ones and replaces bracketed ones by
    their parts, as many steps as the text has opening brackets. One unequal pair makes the list null.
    """
    none = F.array().cast("array<struct<x:string,y:string>>")

    def rest(pair: Column) -> Column:
        """What is left to decide of a pair: nothing, its parts, or null for unequal."""
        return let(by_value, pair, F.transform(F.array(pair["x"], pair["y"]), as_number))

    def by_value(pair: Column, values: Column) -> Column:
        x, y = values[0], values[1]
        both = x.isNotNull() & y.isNotNull()
        return (
            F.when(both & numbers_agree(x, y, percent, rel_tol), none)
            .when(both | (pair["x"] == ""), F.lit(None))
            .otherwise(let(by_text, strip(pair["x"]), strip(pair["y"])))
        )

    def by_text(a: Column, b: Column) -> Column:
        return F.when(_bare_equal(a, b), none).when(
            _both_wrapped(a, b), let(by_parts, _parts(a), _parts(b))
        )

    def by_parts(p: Column, q: Column) -> Column:
        pairs = F.zip_with(p, q, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.when(F.size(p) == F.size(q), pairs)

    opened = F.length(gold) - F.length(F.translate(gold, "([", ""))
    left = F.aggregate(
        F.sequence(F.lit(0), opened),
        F.array(F.struct(gold.alias("x"), prediction.alias("y"))),
        lambda todo, _: F.flatten(F.transform(todo, rest)),
    )
    return F.coalesce(F.size(left) == 0, F.lit(False)) & left.isNotNull()


def latex_verdict(
    gold: Column, prediction: Column, percent: bool = True, rel_tol: float = 1e-4
) -> Column:
    """Equality of LaTeX answers and what a reader should look at, as one struct.

    Fields: ``correct``; ``raw_compared`` (no normal form, texts taken as they
    are); ``needs_symbolic`` (unequal, but only algebra could tell for certain).
    """

    def forms(sides: Column) -> Column:
        return let(normal, sides, F.exists(sides, latex.abnormal))

    def normal(sides: Column, raw: Column) -> Column:
        chosen = F.when(raw, sides).otherwise(F.transform(sides, latex.normalize))
        return let(judge, chosen, raw)

    def judge(sides: Column, raw: Column) -> Column:
        a, b = sides[0], sides[1]
        equal = F.when(a == b, F.lit(True)).otherwise(answers_equal(a, b, percent, rel_tol))
        return let(flags, sides, raw, equal)

    def flags(sides: Column, raw: Column, equal: Column) -> Column:
        numbers = F.forall(sides, is_number)
        settled = equal | numbers | (sides[0] == "")
        return _verdict(equal, raw, ~settled)

    no = F.lit(False)
    return F.when(
        gold.isNotNull() & prediction.isNotNull(), let(forms, F.array(gold, prediction))
    ).otherwise(_verdict(gold.isNull() & prediction.isNull(), no, no))


def _verdict(correct: Column, raw: Column, symbolic: Column) -> Column:
    return F.struct(
        correct.alias("correct"),
        raw.alias("raw_compared"),
        symbolic.alias("needs_symbolic"),
    )


def latex_equal(
    gold: Column, prediction: Column, percent: bool = True, rel_tol: float = 1e-4
) -> Column:
    """Equality of LaTeX answers alone; two missing answers are equal."""
    return latex_verdict(gold, prediction, percent, rel_tol)["correct"]


def command_correct(gold_command: Column, predicted_command: Column) -> Column:
    """Equal canonical JSON; a missing or JSON-null prediction is wrong."""
    return F.coalesce(
        (predicted_command != "null") & (predicted_command == gold_command), F.lit(False)
    )


def in_language(correct: Column, probability: Column, threshold: float = 0.5) -> Column:
    """Correct and written in the wanted language."""
    return F.coalesce(correct & (probability > threshold), F.lit(False))


def reward(correct: Column) -> Column:
    """+1 for correct, -1 for anything else."""
    return F.when(correct, F.lit(1.0)).otherwise(F.lit(-1.0))


def base_passed(base_status: Column, success: str = "pass") -> Column:
    return F.coalesce(base_status == success, F.lit(False))


def plus_passed(base_status: Column, plus_status: Column, success: str = "pass") -> Column:
    """The extra tests only count when the base tests passed as well."""
    return base_passed(base_status, success) & base_passed(plus_status, success)
