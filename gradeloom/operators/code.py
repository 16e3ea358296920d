"""Cleaning generated Python code. Text is only ever parsed, never executed.

All steps are native string and array expressions on staged columns; Python
workers see nothing but the pieces whose syntax has to be checked.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import WS, before_first, behind_first, let, lstrip, rstrip, strip, swap

# Line ends of Python's str.splitlines, kept and cut line starts.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
KEPT_STARTS = ("def ", "import ", "from ")
CUT_STARTS = ('"""', "if", "print")


def _parses(code: str | None) -> bool:
    if code is None:
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether each text is valid Python; a missing text or a NUL byte is not."""
    return code.map(_parses).astype(bool)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def all_parse(pieces: pd.Series) -> pd.Series:
    """Validity of every piece of an array, behind the ``def`` it was cut at."""
    return pieces.map(
        lambda parts: None if parts is None else [_parses("\ndef " + part) for part in parts]
    )


def lines_of(text: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    lines = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(
            F.try_element_at(lines, F.lit(-1)) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)
        ).otherwise(lines)
    )


def _fenced_chunk(text: Column, head: Column) -> Column:
    """The first fenced chunk with the function head, else the whole text."""
    plain = swap(text, "\n```python\n", "\n```\n")
    chunks = F.split(plain, "\n```\n", -1)
    return let(
        lambda t, parts, h: F.coalesce(F.get(F.filter(parts, lambda c: c.contains(h)), F.lit(0)), t),
        plain,
        chunks,
        head,
    )


def _four_spaces(text: Column) -> Column:
    """Lines indented by exactly three characters get one more; all get a line end."""
    return F.array_join(
        F.transform(
            lines_of(text),
            lambda line: F.concat(
                F.when(F.length(line) - F.length(lstrip(line)) == 3, F.lit(" ")).otherwise(F.lit("")),
                line,
                F.lit("\n"),
            ),
        ),
        "",
    )


def _starts(line: Column, starts: Sequence[str]) -> Column:
    out = line.startswith(starts[0])
    for start in starts[1:]:
        out = out | line.startswith(start)
    return out


def _indented_only(text: Column, call: Column) -> Column:
    """Drop unindented lines but definitions and imports; stop at a trailing script.

    The first line that opens the wanted function is always kept.
    """

    def classify(lines: Column, opening: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: line.startswith(opening)), True)
        return let(judge, lines, first)

    def judge(lines: Column, first: Column) -> Column:
        def kind(line: Column, i: Column) -> Column:
            free = (i + 1 == first) | (strip(line) == "") | _starts(line, KEPT_STARTS)
            return (
                F.when(free, F.lit(0))
                .when(_starts(rstrip(line), CUT_STARTS), F.lit(2))
                .when(F.length(line) == F.length(lstrip(line)), F.lit(1))
                .otherwise(F.lit(0))
            )

        return let(find_stop, lines, F.transform(lines, kind))

    def find_stop(lines: Column, kinds: Column) -> Column:
        return let(select, lines, kinds, F.array_position(kinds, 2))

    def select(lines: Column, kinds: Column, stop: Column) -> Column:
        return F.filter(
            lines, lambda line, i: (F.get(kinds, i) == 0) & ((stop == 0) | (i + 1 < stop))
        )

    return F.array_join(let(classify, lines_of(text), call), "\n")


def clean_code(
    df: DataFrame,
    code: str,
    entry_point: str,
    out: str = "cleaned",
    eofs: Sequence[str] = (),
    drop_prefix: str | None = None,
) -> DataFrame:
    """Add ``out``: the code reduced to the entry function and what it may need."""
    text = strip(F.col(code))
    if drop_prefix is not None:
        kept = F.filter(lines_of(text), lambda line: ~line.startswith(drop_prefix))
        text = F.array_join(kept, "\n")
    head = F.concat(F.lit("def "), F.col(entry_point))
    call = F.concat(head, F.lit("("))
    # The name is matched as plain text, also where it looks like a pattern.
    pattern = F.concat(F.lit(r"def \Q"), F.col(entry_point), F.lit(rf"\E[{WS}]*\("))

    staged = df.withColumns(
        {"_chunk": _fenced_chunk(F.concat(F.lit("\n"), text), head), "_call": call}
    ).withColumn("_pieces", F.split(F.col("_chunk"), pattern, -1))
    returning = F.filter(
        behind_first(F.col("_pieces")),
        lambda piece: before_first(piece, "\ndef").contains("    return "),
    )
    joined = let(
        lambda bodies, opening: F.when(
            F.size(bodies) > 0, F.concat(opening, _join_with(bodies, opening))
        ).otherwise(F.lit("")),
        returning,
        F.col("_call"),
    )
    body = _four_spaces(joined)
    for eof in eofs:
        body = before_first(body, eof)
    staged = staged.withColumn("_body", body)
    whole = F.concat(F.get("_pieces", F.lit(0)), _indented_only(F.col("_body"), F.col("_call")))
    staged = staged.withColumn("_parts", F.split(whole, "\ndef ", -1))
    staged = staged.withColumn("_functions", behind_first(F.col("_parts")))
    staged = staged.withColumn("_valid", all_parse(F.col("_functions")))

    def wanted(part: Column, i: Column) -> Column:
        named = strip(part)
        entry = F.col(entry_point)
        own = named.startswith(F.concat(entry, F.lit(" "))) | named.startswith(
            F.concat(entry, F.lit("("))
        )
        return own | F.get(F.col("_valid"), i)

    kept = F.concat(F.slice("_parts", F.lit(1), F.lit(1)), F.filter("_functions", wanted))
    return staged.withColumn(out, strip(F.array_join(kept, "\ndef "))).drop(
        "_chunk", "_call", "_pieces", "_body", "_parts", "_functions", "_valid"
    )


def _join_with(parts: Column, separator: Column) -> Column:
    """``array_join`` with a separator that is itself a column."""
    return F.aggregate(
        behind_first(parts),
        F.get(parts, F.lit(0)),
        lambda acc, part: F.concat(acc, separator, part),
    )
