"""Small text helpers shared by the extractors, graders and prompt builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space; Spark's own ``trim`` removes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def drop_text(text: Column, *pieces: str) -> Column:
    """Remove every occurrence of each literal piece, one piece after the other."""
    for piece in pieces:
        text = F.replace(text, F.lit(piece), F.lit(""))
    return text


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def before_first(text: Column, marker: str) -> Column:
    """Text before the first marker, the whole text when there is none."""
    return F.substring_index(text, marker, 1)


def after_last(text: Column, marker: str) -> Column:
    """Text after the last marker, the whole text when there is none."""
    return F.substring_index(text, marker, -1)


def count_of(text: Column, piece: str) -> Column:
    """How often a literal piece occurs, without overlaps."""
    return ((F.length(text) - F.length(drop_text(text, piece))) / len(piece)).cast("int")


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` applied to the values, each computed once however often it is used.

    Without it an expression that names its input several times doubles the plan
    at every step.
    """
    fields = [v.alias(f"v{i}") for i, v in enumerate(values)]
    bound = F.transform(
        F.array(F.struct(*fields)), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])
    )
    return F.get(bound, F.lit(0))


def behind_first(parts: Column) -> Column:
    """All but the first element of a non-empty array."""
    return F.slice(parts, F.lit(2), F.size(parts))
