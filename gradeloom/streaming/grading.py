"""Grading generations as they arrive.

Extraction and grading keep no state, so the batch column functions run on a
stream unchanged; this module only joins a stream to its static gold answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame


def grade_stream(
    generations: DataFrame,
    samples: DataFrame,
    extract: Callable[[Column], Column],
    correct: Callable[[Column, Column], Column],
    key: str = "sample_id",
    output: str = "generation",
    answer: str = "answer",
) -> DataFrame:
    """Stream of generations joined to static samples, with prediction and correctness."""
    joined = generations.join(samples, key)
    graded = joined.withColumn("prediction", extract(joined[output]))
    return graded.withColumn("correct", correct(graded[answer], graded["prediction"]))
