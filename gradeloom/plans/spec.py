"""Task specifications: what a named task asks, how it is split, graded and rewarded.

A specification is a set of pure functions on columns and DataFrames. Each
``question`` expects the columns of the dataset it is named after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import grade as G
from gradeloom.functions import prompts as P
from gradeloom.operators import splits as S
from gradeloom.plans import evaluate as V

# The context messages of the tasks.
SYSTEM_TEXT = {
    "gsm8k": (
        "Below is an instruction that describes a task."
        " Write a response that appropriately completes the request.\n\n"
    ),
    "aqua": (
        "Below is an math MCQ. Calculate and Answer it. Stop calculate when the conclusion is clear. Answer briefly. "
        "Stop calculate when the conclusion is clear. Answer briefly. Do not include unnecessary steps."
        "Return the final answer you select in A,B,C,D,E directly at last."
    ),
    "arc": (
        "The following are multiple choice questions (with answers). "
        "Think step by step and then finish your answer "
        'with "the answer is (X)" where X is the correct letter choice.'
    ),
    "math": (
        "Solve the question below by reasoning step by step,"
        "and put the final answer within \\boxed{}."
    ),
    "mbpp": (
        "You are an exceptionally intelligent coding assistant that "
        " consistently delivers accurate and reliable responses to user "
        "instructions."
    ),
    "category": """
    # Analyze the given question and classify it into one of four categories: 'code', 'math', 'reasoning' or 'other'. Follow these guidelines:

    1. Code: Questions asking for programming solutions, functions, algorithms. Often includes specific programming terms, language syntax, or data structures.
    2. Math: Questions involving mathematical calculations, formulas, statistics. Often includes numbers, equations, or mathematical operations.
    3. Reasoning: Questions requiring logical thinking, application of scientific knowledge, or critical analysis of information. Often presents statements that need evaluation based on general understanding. 
    4. Other: Questions not clearly fit into above categories.

    Instructions:
    - Consider the primary focus, skills, and knowledge required to answer the question.
    - If a question spans multiple categories, choose the most dominant one.
    - Provide your final classification within \\boxed{} notation. Example: \\boxed{reasoning}

    Format your response as follows:
    Classification: \\boxed{category}
    """,
}


@dataclass(frozen=True)
class TaskSpec:
    """One task. ``system`` None means that a row brings its own context text."""

    name: str
    question: Callable[[], Column]
    render: Callable[[Column], Column]
    evaluate: Callable[..., V.Evaluation]
    split: Callable[[DataFrame], DataFrame] | None = None
    gold: Callable[[], Column] | None = None
    prefill: Callable[[], Column] | None = None
    system: str | None = None
    system_column: str | None = None
    metrics: dict[str, str] = field(default_factory=lambda: _metrics("acc"))
    reward: Callable[[Column], Column] = G.reward
    rewarded: str = "correct"

    def messages(self) -> Column:
        context = None
        if self.system_column is not None:
            context = F.col(self.system_column)
        elif self.system is not None:
            context = F.lit(self.system)
        start = None if self.prefill is None else self.prefill()
        return P.build_messages(self.question(), context, start)

    def prompt(self) -> Column:
        """The rendered prompt, with the start of the response where there is one."""
        return P.render_with_prefill(self.messages(), self.render)

    def rewards(self, details: DataFrame) -> DataFrame:
        return details.withColumn("reward", self.reward(F.col(self.rewarded)))


def _metrics(name: str, transfer: str | None = None) -> dict[str, str]:
    out = {split: name for split in ("train", "valid", "test")}
    return out | ({"transfer": transfer} if transfer else {})


def _by_parity(samples: DataFrame) -> DataFrame:
    return samples.withColumn("split", S.parity_split(F.col("ordinal")))


def _code_split(samples: DataFrame) -> DataFrame:
    """The first 300 problems are the pool, shuffled into 200 train and 100 valid ones;
    the rest is the test set."""
    marked = samples.withColumn("_pool", F.col("ordinal") < 300)
    split = S.seeded_split(marked, "task_id", 16, 200, group=["_pool"])
    chosen = F.when(F.col("_pool"), F.col("split")).otherwise("test")
    return split.withColumn("split", chosen).drop("_pool", "shuffled")


def _category_split(samples: DataFrame) -> DataFrame:
    """Four of five rows are for training; of those every other one validates."""
    place = F.col("ordinal")
    inner = S.parity_split(S.four_to_one_position(place))
    outer = S.four_to_one_split(place)
    return samples.withColumn("split", F.when(outer == "train", inner).otherwise("test"))


def _code_eval(clean: bool, source: str) -> Callable[..., V.Evaluation]:
    def run(problems: DataFrame, completions: DataFrame, verdicts: DataFrame, **options: object):
        return V.code_answers(problems, completions, verdicts, source, clean, **options)

    return run


def _no_languages(evaluate: Callable[..., V.Evaluation]) -> Callable[..., V.Evaluation]:
    def run(samples: DataFrame, generations: DataFrame, positions: DataFrame | None = None):
        return evaluate(samples, generations, positions, languages=())

    return run


def _header_steps(messages: Column) -> Column:
    return P.render_header_style(messages, suffix=P.STEP_BY_STEP)


TASKS: dict[str, TaskSpec] = {
    spec.name: spec
    for spec in [
        TaskSpec(
            "gsm8k",
            question=lambda: F.col("question"),
            gold=lambda: P.gold_number(F.col("answer")),
            render=P.render_header_style,
            evaluate=_no_languages(V.number_answers),
            split=_by_parity,
            system=SYSTEM_TEXT["gsm8k"],
        ),
        TaskSpec(
            "aqua",
            question=lambda: P.options_prompt(F.col("question"), F.col("options")),
            gold=lambda: F.col("correct"),
            render=P.render_im_start_style,
            evaluate=_no_languages(V.letter_answers),
            system=SYSTEM_TEXT["aqua"],
            split=lambda samples: S.tail_holdout(samples, 5000, 256),
        ),
        TaskSpec(
            "arc",
            question=lambda: P.lettered_options(F.col("question"), F.col("choices.text")),
            gold=lambda: F.col("answerKey"),
            render=_header_steps,
            evaluate=V.choice_answers,
            system=SYSTEM_TEXT["arc"],
            split=_by_parity,
            metrics=_metrics("acc", "acc"),
        ),
        TaskSpec(
            "math",
            question=lambda: F.col("problem"),
            gold=lambda: P.gold_box(F.col("solution")),
            render=P.render_header_style,
            evaluate=V.latex_answers,
            system=SYSTEM_TEXT["math"],
        ),
        TaskSpec(
            "mbpp",
            question=lambda: P.code_task_from_docstring(F.col("prompt"))[0],
            prefill=lambda: P.code_task_from_docstring(F.col("prompt"))[1],
            render=P.render_instruction_style,
            evaluate=_code_eval(True, "mbpp"),
            split=_code_split,
            system=SYSTEM_TEXT["mbpp"],
            metrics=_metrics("mbpp_base_pass@1", "humaneval_base_pass@1"),
            reward=V.code_reward,
            rewarded="base_correct",
        ),
        TaskSpec(
            "humaneval",
            question=lambda: P.code_task_from_prompt(F.col("prompt"))[0],
            prefill=lambda: P.code_task_from_prompt(F.col("prompt"))[1],
            render=P.render_instruction_style,
            evaluate=_code_eval(False, "humaneval"),
            system=SYSTEM_TEXT["mbpp"],
            metrics=_metrics("humaneval_base_pass@1"),
            reward=V.code_reward,
            rewarded="base_correct",
        ),
        TaskSpec(
            "iot",
            question=lambda: F.col("user_input"),
            gold=lambda: F.col("ai_output"),
            render=P.render_im_start_style,
            evaluate=V.command_answers,
            split=_by_parity,
            system_column="prompt",
        ),
        TaskSpec(
            "category",
            question=lambda: F.col("question"),
            gold=lambda: F.col("label"),
            render=P.render_header_style,
            evaluate=V.category_answers,
            system=SYSTEM_TEXT["category"],
            split=_category_split,
        ),
    ]
}


def few_shot(name: str, split: str = "test", shots: int = 5, seed: int = 16) -> TaskSpec:
    """Train on a few rows of one split of a task and evaluate on that same split."""
    inner = TASKS[name]
    if split not in inner.metrics:
        raise ValueError(f"task {name!r} has no {split!r} split")

    def shuffle(samples: DataFrame) -> DataFrame:
        chosen, _ = S.choose_split(samples, split, inner.metrics)
        key = "task_id" if "task_id" in chosen.columns else "sample_id"
        return S.seeded_split(chosen.drop("split"), key, seed, shots)

    return replace(inner, split=shuffle, metrics=_metrics(inner.metrics[split]))
