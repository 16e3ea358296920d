"""Answer extraction from generated text, as native column expressions.

Whatever looks for a *last* hit searches the reversed text for the first one and
turns the hit around: the search ends at the hit, and no array of all hits is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import WS, after_last, before_first, strip

FENCE = "```"
# The labels an expert exists for, and the label of all others.
EXPERT_LABELS = ("code", "math", "reasoning")
OTHER_LABEL = "other"


def _hit(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group, null when the pattern is absent or the capture is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last_hit(text: Column, reversed_pattern: str) -> Column:
    return F.reverse(_hit(F.reverse(text), reversed_pattern, 0))


def last_number(text: Column, mode: str = "plain") -> Column:
    """Last number in the text, as a double.

    ``plain`` reads unsigned numbers without thousands separators, so
    ``1,234`` gives 234 and ``-5`` gives 5. ``strict`` keeps sign and commas.
    """
    if mode == "strict":
        pattern = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|[-+]?\.\d+"
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        last = F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(","), F.lit(""))
        return last.try_cast("double")
    # A number never leaves a run of digits and dots, so only the last run that
    # ends in a digit has to be read from the left.
    run = _last_hit(text, r"[0-9][0-9.]*")
    hits = F.regexp_extract_all(run, F.lit(r"\d*\.?\d+"), F.lit(0))
    return F.try_element_at(hits, F.lit(-1)).try_cast("double")


def last_option_letter(text: Column) -> Column:
    """Last capital A to E anywhere, also inside a word."""
    return _last_hit(text, r"[A-E]")


def choice_letter(text: Column) -> Column:
    """A to J: after "answer is", else on an "Answer:" line, else the last standalone letter."""
    stated = _hit(text, r"answer is \(?([A-J])\)?")
    on_line = _hit(text, rf"(?dm)^.*[aA]nswer:[{WS}]*([A-J])")
    alone = _last_hit(text, r"(?<![\p{L}\p{N}_])[A-J](?![\p{L}\p{N}_])")
    return F.coalesce(stated, on_line, alone)


def first_box(text: Column) -> Column:
    r"""Content of the first ``\boxed{...}`` up to the next brace; may be empty."""
    whole = F.regexp_substr(text, F.lit(r"\\boxed\{[^}]*\}"))
    return F.substring(whole, F.lit(8), F.length(whole) - 8)


def last_balanced_box(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces, null otherwise.

    The fold runs over the pieces between closing braces, so its length is the
    number of braces after the marker, not the number of characters.
    """
    tail = after_last(text, "\\boxed")
    pieces = F.split(tail, r"\}", -1)
    closers = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(-1).alias("end")
    )

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = state["depth"] + opened - 1
        read = state["read"] + F.length(piece) + 1
        end = F.when(state["end"] >= 0, state["end"]).when(depth == 0, read).otherwise(-1)
        return F.struct(depth.alias("depth"), read.alias("read"), end.alias("end"))

    end = F.aggregate(closers, start, step, lambda state: state["end"])
    content = F.when(end > 0, F.substring(tail, F.lit(2), end - 2))
    return F.when(text.contains("\\boxed") & tail.startswith("{"), content)


def final_answer(text: Column, phrase: str = "The answer is: ") -> Column:
    """Text after the last phrase up to a full stop at a line end, else the last box."""
    said = strip(before_first(after_last(text, phrase), ".\n"))
    undotted = F.when(said.endswith("."), F.substring(said, F.lit(1), F.length(said) - 1))
    return F.when(text.contains(phrase), strip(F.coalesce(undotted, said))).otherwise(
        last_balanced_box(text)
    )


def json_command(text: Column, member: str = "command") -> Column:
    """Canonical JSON text of a top-level member; null on bad text or no such member.

    A JSON null member comes back as the text ``null``. Keys are written sorted
    and whole numbers without a fraction, so equal values give equal text.
    """
    value = F.try_variant_get(F.try_parse_json(text), f"$.{member}", "variant")
    return F.to_json(value)


def malformed_json(text: Column) -> Column:
    """Text that is present but not readable as JSON."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def completion_body(text: Column) -> Column:
    """Text before the first code fence, all of it when there is none."""
    return before_first(text, FENCE)


def explanation(text: Column) -> Column:
    """Text after the first fence, trimmed; without a fence, all but two characters."""
    at = F.instr(text, FENCE)
    return strip(
        F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(
            F.substring(text, 3, 2147483647)
        )
    )


def expert_label(label: Column, known: Sequence[str] = EXPERT_LABELS) -> Column:
    """The label when an expert is known for it, else ``other``; null gives ``other``."""
    return F.when(label.isin(*known), label).otherwise(F.lit(OTHER_LABEL))


def cut_at_stops(text: Column, stops: Sequence[str]) -> Column:
    """Text before the earliest stop string."""
    starts = [F.nullif(F.instr(text, stop), F.lit(0)) for stop in stops]
    first = starts[0] if len(starts) == 1 else F.least(*starts)
    return F.coalesce(F.substring(text, F.lit(1), first - 1), text)
