"""Samples and prompts: question texts, code tasks, messages and chat renderings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.extract import last_balanced_box, last_number
from gradeloom.functions.text import strip

MESSAGES = "array<struct<role:string,content:string>>"
QUOTES = '"""'


# --- samples -------------------------------------------------------------


def gold_number(solution: Column) -> Column:
    """Last number of a worked solution, cut toward zero; stays a double."""
    value = last_number(solution)
    return F.when(value < 0, -F.floor(-value).cast("double")).otherwise(
        F.floor(value).cast("double")
    )


def gold_box(solution: Column) -> Column:
    """Content of the last balanced box of a worked solution."""
    return last_balanced_box(solution)


def options_prompt(question: Column, options: Column) -> Column:
    """Question, the line "Options: " and one option per line, as they are."""
    return F.concat(question, F.lit("\nOptions: \n"), F.array_join(options, "\n"))


def lettered_options(question: Column, options: Column) -> Column:
    """Question and options lettered from A, all of them; see :func:`options_error`."""
    lines = F.transform(
        options,
        lambda text, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), text, F.lit("\n")),
    )
    return F.concat(question, F.lit("\nOptions:\n"), F.array_join(lines, ""))


def options_error(options: Column, max_options: int = 5) -> Column:
    """Why a question does not fit its answer letters; null when it does."""
    said = F.concat_ws(" ", F.size(options), F.lit(f"options, but only {max_options} letters"))
    return F.when(F.size(options) > max_options, said)


def code_task_from_docstring(prompt: Column) -> tuple[Column, Column]:
    """(instruction, response prefix) from the text between the outer triple quotes.

    Null when there is no closing triple quote or no assertion in it.
    """
    opening = F.instr(prompt, QUOTES)
    behind = F.length(F.substring_index(prompt, QUOTES, -1))
    inner_length = F.length(prompt) - behind - 3 - (opening + 2)
    inner = F.when(
        (opening > 0) & (inner_length >= 0),
        F.substring(prompt, opening + 3, inner_length),
    )
    at = F.nullif(F.instr(inner, "assert"), F.lit(0))
    task = strip(F.substring(inner, F.lit(1), at - 1))
    checks = strip(F.substring(inner, at, F.length(inner)))
    sentence = F.when(task.endswith("."), task).otherwise(F.concat(task, F.lit(".")))
    instruction = F.concat(
        sentence,
        # Fixed value: the wording that models of this task were shown.
        F.lit(" Your code should satisfy the following assertion:\n```python\n"),
        checks,
        F.lit("\n```"),
    )
    return instruction, F.lit("```python")


def code_task_from_prompt(prompt: Column) -> tuple[Column, Column]:
    """(instruction, response prefix) wrapping a bare function stub."""
    stub = strip(prompt)
    instruction = F.concat(
        # Fixed value: the wording that models of this task were shown.
        F.lit("Write a solution to the following problem:\n```python\n"), stub, F.lit("\n```")
    )
    return instruction, F.concat(F.lit("```python\n"), stub)


def full_source(prompt: Column, completion: Column, solution: Column, sep: str = "") -> Column:
    """The stored solution, else prompt and completion. The cleaner joins with a newline."""
    return F.coalesce(solution, F.concat(prompt, F.lit(sep), completion))


def problem_text(columns: Sequence[Column]) -> Column:
    """First non-null of the candidate question columns."""
    return F.coalesce(*columns)


# --- messages ------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(
    user: Column, system: Column | None = None, prefill: Column | None = None
) -> Column:
    """Ordered messages: context, user turn, optional start of the response."""
    parts = [] if system is None else [message("system", system)]
    parts.append(message("user", user))
    if prefill is not None:
        parts.append(message("assistant_prefill", prefill))
    return F.array(*parts).cast(MESSAGES)


# --- chat renderings: one piece of text per message ----------------------
# Fixed values below: the marks of the three chat formats, as models know them.


def header_of(role: Column) -> Column:
    return F.concat(
        F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n")
    )


def header_piece(role: Column, content: Column) -> Column:
    """One message in header style."""
    return F.concat(header_of(role), strip(content), F.lit("<|eot_id|>"))


HEADER_GENERATION = "<|start_header_id|>assistant<|end_header_id|>\n\n"
STEP_BY_STEP = "Let's think step by step"


def im_start_piece(role: Column, content: Column) -> Column:
    """One message in im_start style."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), strip(content), F.lit("<|im_end|>"))


IM_START_GENERATION = "<|im_start|>assistant\n"
EMPTY_THINK = "<think>\n\n</think>\n\n"


def instruction_piece(role: Column, content: Column, position: Column) -> Column:
    """One message in instruction style; a system text counts only in front."""
    return (
        F.when((role == "system") & (position == 0), F.concat(strip(content), F.lit("\n\n")))
        .when(role == "user", F.concat(F.lit("@@ Instruction:\n"), strip(content), F.lit("\n\n")))
        .when(role == "assistant", F.concat(F.lit("@@ Response:\n"), strip(content)))
        .otherwise(F.lit(""))
    )


RESPONSE_MARK = "@@ Response:"


def _joined(messages: Column, piece: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(messages, lambda m: piece(m["role"], m["content"])), "")


def render_header_style(
    messages: Column, begin: str = "", generation: bool = True, suffix: str = ""
) -> Column:
    """Header style; ``suffix`` follows the generation header (step-by-step variant)."""
    tail = HEADER_GENERATION + suffix if generation else ""
    front = F.when(F.size(messages) > 0, F.lit(begin)).otherwise(F.lit(""))
    return F.concat(front, _joined(messages, header_piece), F.lit(tail))


def render_im_start_style(
    messages: Column, generation: bool = True, think_tail: str = EMPTY_THINK
) -> Column:
    """im_start style; the empty-think tail is there with or without a generation header."""
    tail = (IM_START_GENERATION if generation else "") + think_tail
    return F.concat(_joined(messages, im_start_piece), F.lit(tail))


def _loop_messages(messages: Column) -> Column:
    """Messages behind a leading system message."""
    has_system = F.get(messages, F.lit(0))["role"] == "system"
    return F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)


def roles_alternate(messages: Column) -> Column:
    """User turns on even places and nothing else there, after a leading system message."""
    checked = F.transform(
        _loop_messages(messages), lambda m, i: (m["role"] == "user") == (i % 2 == 0)
    )
    return F.forall(checked, lambda ok: ok)


def render_instruction_style(messages: Column, generation: bool = True) -> Column:
    """Instruction style; null where the roles do not alternate."""
    pieces = F.transform(messages, lambda m, i: instruction_piece(m["role"], m["content"], i))
    last_is_user = F.try_element_at(messages, F.lit(-1))["role"] == "user"
    tail = F.when(last_is_user & F.lit(generation), F.lit(RESPONSE_MARK)).otherwise(F.lit(""))
    return F.when(roles_alternate(messages), F.concat(F.array_join(pieces, ""), tail))


def prefill_error(messages: Column) -> Column:
    """Why the start of a response cannot be used, null when it can."""
    count = F.size(F.filter(messages, lambda m: m["role"] == "assistant_prefill"))
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.when(count > 1, F.lit("more than one prefill")).when(
        (count == 1) & (last != "assistant_prefill"), F.lit("prefill is not the last message")
    )


def render_with_prefill(messages: Column, render: Callable[[Column], Column]) -> Column:
    """Render all but a closing prefill, then append its text; null on a misplaced one."""
    rest = F.filter(messages, lambda m: m["role"] != "assistant_prefill")
    start = F.get(F.filter(messages, lambda m: m["role"] == "assistant_prefill"), F.lit(0))
    whole = F.concat(render(rest), F.coalesce(start["content"], F.lit("")))
    return F.when(prefill_error(messages).isNull(), whole)
