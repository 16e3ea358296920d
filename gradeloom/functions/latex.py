"""Normal form of short LaTeX answers, as a chain of native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import before_first, behind_first, count_of, drop_text, let, swap

UNIT_MARK = "\\text{ "


def _commands(text: Column) -> Column:
    """Unify spellings of commands and drop layout-only ones."""
    text = swap(drop_text(text, "\n", "\\!"), "\\\\", "\\")
    text = swap(swap(text, "tfrac", "frac"), "dfrac", "frac")
    return drop_text(text, "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")


def _numbers(text: Column) -> Column:
    """Drop unit and percent sign, write leading zeros, keep the right of ``x=``."""
    text = drop_text(before_first(text, UNIT_MARK), "\\\\%", "\\%")
    text = swap(swap(text, " .", " 0."), "{.", "{0.")
    text = F.regexp_replace(text, r"\A\.", "0.")
    return F.regexp_replace(text, r"\A[^=]{0,2}=([^=]*)\z", "$1")


def _roots(text: Column) -> Column:
    r"""``\sqrt`` before a bare character gets braces around it; then spaces go."""
    return drop_text(F.regexp_replace(text, r"\\sqrt([^{])", r"\\sqrt{$1}"), " ")


def _first_short_argument(text: Column) -> Column:
    r"""Length of the first ``\frac`` argument text that is too short, null when none is."""
    behind = behind_first(F.split(text, r"\\frac", -1))
    short = F.filter(behind, lambda piece: (F.length(piece) < 2) & (piece != "{"))
    return F.length(F.get(short, F.lit(0)))


def _fractions(text: Column) -> Column:
    r"""``\frac`` with bare arguments gets braces; one cut-off argument stops all of it."""

    def braces(t: Column) -> Column:
        bare = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
        return F.regexp_replace(bare, r"\\frac([^{])\{", r"\\frac{$1}{")

    return let(
        lambda t: F.when(_first_short_argument(t) == 1, t).otherwise(braces(t)), text
    )


def normalize(text: Column) -> Column:
    """Normal form; meaningful only where :func:`abnormal` is false."""
    text = _fractions(_roots(_numbers(_commands(text))))
    text = F.regexp_replace(text, r"\A0\.5\z", r"\\frac{1}{2}")
    whole = r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z"
    return F.regexp_replace(text, whole, r"\\frac{$1}{$2}")


def abnormal(text: Column) -> Column:
    r"""No normal form: two units, or a ``\sqrt`` or ``\frac`` with nothing behind it."""

    def loose_root(t: Column) -> Column:
        return t.endswith("\\sqrt") | t.contains("\\sqrt\\sqrt")

    def loose_fraction(t: Column) -> Column:
        return F.coalesce(_first_short_argument(_roots(t)) == 0, F.lit(False))

    return let(
        lambda t: (count_of(t, UNIT_MARK) > 1)
        | let(lambda n: loose_root(n) | loose_fraction(n), _numbers(t)),
        _commands(text),
    )
