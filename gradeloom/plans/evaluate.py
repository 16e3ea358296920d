"""Evaluations: samples joined to generations, answers extracted, graded, reported.

Each takes ``samples`` and ``generations(sample_id, generation)`` and returns the
metrics as (metric, value) rows and one detail row per sample. All of it is one
lazy plan; nothing is computed before a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import extract as E
from gradeloom.functions import grade as G
from gradeloom.functions.prompts import full_source
from gradeloom.functions.text import strip
from gradeloom.operators.code import clean_code
from gradeloom.operators.joins import with_experts, with_generations
from gradeloom.operators.reports import (
    accuracy,
    attempts_per_task,
    numbered_attempts,
    pass_at_k_report,
    routed_report,
    with_verdict_counts,
)
from gradeloom.operators.splits import pick_positions


class Evaluation(NamedTuple):
    metrics: DataFrame
    details: DataFrame


def _attempted(
    samples: DataFrame, generations: DataFrame, positions: DataFrame | None
) -> DataFrame:
    chosen = pick_positions(samples, positions)
    return with_generations(chosen, generations).withColumnRenamed("generation", "output")


def _metric_rows(wide: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in wide.columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def _with_languages(
    details: DataFrame, languages: Sequence[str] | None, prefix: str = "lang_"
) -> Evaluation:
    """Overall accuracy and the share correct and written in each language.

    By default every language with a probability column of its own is reported. One asked
    for by name that has none counts as certain.
    """
    if languages is None:
        languages = [c.removeprefix(prefix) for c in details.columns if c.startswith(prefix)]
    for lang in languages:
        if f"{prefix}{lang}" not in details.columns:
            details = details.withColumn(f"{prefix}{lang}", F.lit(1.0))
    aggs = [accuracy(F.col("correct")).alias("acc")]
    for lang in languages:
        fluent = G.in_language(F.col("correct"), F.col(f"{prefix}{lang}"))
        aggs.append(accuracy(fluent).alias(f"acc_{lang}"))
    return Evaluation(_metric_rows(details.agg(*aggs)), details)


def _plain(details: DataFrame) -> Evaluation:
    return Evaluation(
        _metric_rows(details.agg(accuracy(F.col("correct")).alias("acc"))), details
    )


def grade_letters(rows: DataFrame, null_is_correct: bool = True) -> DataFrame:
    rows = rows.withColumn("prediction", E.last_option_letter(F.col("output")))
    correct = G.same_answer(F.col("answer"), F.col("prediction"), null_is_correct)
    return rows.withColumn("correct", correct)


def letter_answers(
    samples: DataFrame,
    generations: DataFrame,
    positions: DataFrame | None = None,
    languages: Sequence[str] | None = None,
    null_is_correct: bool = True,
) -> Evaluation:
    """Last capital A to E against ``samples.answer``."""
    rows = _attempted(samples, generations, positions)
    return _with_languages(grade_letters(rows, null_is_correct), languages)


def grade_numbers(
    rows: DataFrame, null_is_correct: bool = True, mode: str = "plain"
) -> DataFrame:
    rows = rows.withColumn("prediction", E.last_number(F.col("output"), mode))
    gold = F.col("answer").try_cast("double")
    # An answer that is no number equals nothing, and Spark holds nan equal to itself.
    odd = (F.col("answer").isNotNull() & gold.isNull()) | F.coalesce(F.isnan(gold), F.lit(False))
    correct = G.same_answer(gold, F.col("prediction"), null_is_correct)
    return rows.withColumn("correct", correct & ~odd)


def number_answers(
    samples: DataFrame,
    generations: DataFrame,
    positions: DataFrame | None = None,
    languages: Sequence[str] | None = None,
    null_is_correct: bool = True,
    mode: str = "plain",
) -> Evaluation:
    """Last number against ``samples.answer``, by value."""
    rows = _attempted(samples, generations, positions)
    return _with_languages(grade_numbers(rows, null_is_correct, mode), languages)


def grade_choices(rows: DataFrame, guess: bool = True) -> DataFrame:
    rows = rows.withColumn("prediction", E.choice_letter(F.col("output")))
    said, count = F.col("prediction"), F.size("options")
    return rows.withColumns(
        {
            "correct": G.choice_correct(F.col("answer"), said, count, guess),
            "guess_undefined": G.guess_undefined(said, count),
        }
    )


def choice_answers(
    samples: DataFrame,
    generations: DataFrame,
    positions: DataFrame | None = None,
    guess: bool = True,
) -> Evaluation:
    """Letter A to J against ``samples.answer``; guessed from ``samples.options`` if missing."""
    return _plain(grade_choices(_attempted(samples, generations, positions), guess))


def grade_latex(rows: DataFrame, percent: bool = True) -> DataFrame:
    rows = rows.withColumn("prediction", E.final_answer(F.col("output")))
    verdict = G.latex_verdict(F.col("answer"), F.col("prediction"), percent)
    return rows.withColumn("_verdict", verdict).select(*rows.columns, "_verdict.*")


def latex_answers(
    samples: DataFrame,
    generations: DataFrame,
    positions: DataFrame | None = None,
    percent: bool = True,
) -> Evaluation:
    """Final answer of a worked solution against ``samples.answer``; keeps ``type``."""
    return _plain(grade_latex(_attempted(samples, generations, positions), percent))


def latex_by_type(details: DataFrame) -> DataFrame:
    """Sample count, accuracy and undecided pairs per problem type."""
    return details.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        accuracy(F.col("correct")).alias("acc"),
        F.count_if("needs_symbolic").alias("needs_symbolic"),
    )


def grade_commands(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns(
        {
            "prediction": E.json_command(F.col("output")),
            "answer": E.json_command(F.col("ai_output")),
            "malformed": E.malformed_json(F.col("output")),
        }
    )
    return rows.withColumn("correct", G.command_correct(F.col("answer"), F.col("prediction")))


def command_answers(
    samples: DataFrame, generations: DataFrame, positions: DataFrame | None = None
) -> Evaluation:
    """The ``command`` member of the output against the one of ``samples.ai_output``."""
    return _plain(grade_commands(_attempted(samples, generations, positions)))


def grade_categories(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("prediction", E.first_box(F.col("output")))
    return rows.withColumn("correct", G.same_answer(F.col("label"), F.col("prediction")))


def category_answers(
    samples: DataFrame, generations: DataFrame, positions: DataFrame | None = None
) -> Evaluation:
    """First box against ``samples.label``."""
    return _plain(grade_categories(_attempted(samples, generations, positions)))


def code_answers(
    problems: DataFrame,
    completions: DataFrame,
    verdicts: DataFrame,
    source: str,
    clean: bool,
    ks: Sequence[int] = (1, 10, 100),
    base_only: bool = False,
) -> Evaluation:
    """Completions cleaned and numbered, their verdicts counted, pass@k reported.

    ``problems(task_id, prompt, entry_point)``, ``completions(task_id, ordinal,
    generation)``, ``verdicts(task_id, completion_id, base_status, plus_status)``.
    Tests are run elsewhere on ``details.solution``.
    """
    details = with_solutions(problems, completions, clean)
    flags = {"base": G.base_passed(F.col("base_status"))}
    if not base_only:
        flags["plus"] = G.plus_passed(F.col("base_status"), F.col("plus_status"))
    per_task = attempts_per_task(verdicts, flags)
    counts = per_task.select(
        "task_id", *[F.col(name).alias(f"{name}_correct") for name in flags]
    )
    metrics = pass_at_k_report(per_task, list(flags), ks, f"{source}_").select("metric", "value")
    return Evaluation(metrics, with_verdict_counts(details, counts))


def with_solutions(problems: DataFrame, completions: DataFrame, clean: bool) -> DataFrame:
    """Completions with their number in the task, explanation and full source."""
    rows = numbered_attempts(completions, "task_id", "ordinal").join(problems, "task_id")
    rows = rows.withColumns(
        {
            "completion": E.completion_body(F.col("generation")),
            "explanation": E.explanation(F.col("generation")),
        }
    ).withColumnRenamed("generation", "output")
    stored = F.lit(None).cast("string")
    if not clean:
        source = full_source(F.col("prompt"), F.col("completion"), stored)
        return rows.withColumn("solution", source)
    joined = full_source(F.col("prompt"), F.col("completion"), stored, "\n")
    rows = rows.withColumn("_source", strip(joined))
    return clean_code(rows, "_source", "entry_point", "solution").drop("_source")


def code_reward(base_correct: Column) -> Column:
    """+1 when exactly one completion passed the base tests."""
    return G.reward(base_correct == 1)


def routed_answers(
    samples: DataFrame,
    classifications: DataFrame,
    generations: DataFrame,
    experts: DataFrame,
    grade: Callable[[DataFrame], DataFrame],
) -> Evaluation:
    """Each sample answered by the expert its predicted category names.

    ``classifications(sample_id, classification)`` hold the classifier's output,
    ``generations(sample_id, expert_label, generation)`` the answers of every
    expert, ``experts(expert_label)`` those that exist; ``grade`` is one of the
    graders of this module. Samples without a category, or one without an expert, count in the
    total only; a sample without a stored answer is wrong. Of several answers the first text counts.
    """
    box = E.first_box(F.col("classification"))
    labels = classifications.select("sample_id", E.expert_label(box).alias("expert_label"))
    # One category and one answer per sample, so that none counts twice.
    labels = labels.groupBy("sample_id").agg(F.min("expert_label").alias("expert_label"))
    answers = generations.groupBy("sample_id", "expert_label").agg(F.min("generation").alias("output"))
    routed = with_experts(samples.join(labels, "sample_id", "left"), experts)
    graded = grade(routed.join(answers, ["sample_id", "expert_label"], "left"))
    said = F.col("output").isNotNull()
    graded = graded.withColumn("correct", F.when(F.col("evaluated"), said & F.col("correct")))
    return Evaluation(routed_report(graded), graded)


def split_report(
    details: DataFrame, metrics: dict[str, str] | None = None, train_head: int | None = None
) -> DataFrame:
    """One accuracy per split in a single pass: (split, metric, num_samples, value).

    With ``train_head`` the train metric reads the first so many train rows only,
    by ``split_ordinal``.
    """
    rows = details
    if train_head is not None:
        rows = rows.where((F.col("split") != "train") | (F.col("split_ordinal") < train_head))
    name = F.concat(F.col("split"), F.lit("_acc"))
    if metrics:
        pairs = [F.lit(x) for kv in metrics.items() for x in kv]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("split")), name)
    return rows.groupBy("split").agg(
        F.first(name).alias("metric"),
        F.count(F.lit(1)).alias("num_samples"),
        accuracy(F.col("correct")).alias("value"),
    )
