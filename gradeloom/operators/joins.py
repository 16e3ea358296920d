"""Joining samples, generations, verdicts and experts, and checking what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.vectors import upto


def with_generations(samples: DataFrame, generations: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with their generations; samples without one are in :func:`missing`."""
    return samples.join(generations, key)


def missing(problems: DataFrame, completions: DataFrame, key: str = "task_id") -> DataFrame:
    """Problems without any completion."""
    return problems.join(completions.select(key), key, "left_anti")


def not_single(details: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that do not have exactly one detail row, with their row counts."""
    return (
        details.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != 1)
    )


def completeness(df: DataFrame, identifier: Sequence[str]) -> DataFrame:
    """Row count, number of distinct identifiers, and whether the two agree."""
    per_id = df.groupBy(*identifier).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
    ).withColumn("complete", F.col("n_rows") == F.col("n_distinct"))


#: Labels that are held as a dictionary in the plan; more of them are joined.
MOST_LABELS = 1000


def with_experts(
    samples: DataFrame, experts: DataFrame, label: str = "expert_label", most: int = MOST_LABELS
) -> DataFrame:
    """Samples with ``evaluated``: whether an expert of their label exists.

    The labels of the experts are read at once, ``most`` and one more of them at most. So
    few are looked up where the sample is: a label with a third of all samples, as labels have, moves
    no sample. Beyond that they are joined.
    """
    known = experts.select(label).where(F.col(label).isNotNull()).distinct()
    names = [row[0] for row in known.limit(most + 1).collect()]
    if len(names) <= most:
        evaluated = F.col(label).isin(names) if names else F.lit(False)
        return samples.withColumn("evaluated", F.coalesce(evaluated, F.lit(False)))
    return samples.join(known.withColumn("evaluated", F.lit(True)), label, "left").withColumn(
        "evaluated", F.coalesce("evaluated", F.lit(False))
    )


def only_correct(rows: DataFrame, details: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose sample was graded correct."""
    return rows.join(details.where("correct").select(key), key, "left_semi")


def repeat_requests(df: DataFrame, n: int) -> DataFrame:
    """Every request n times, numbered by ``completion_no``; no rows for n = 0."""
    return df.withColumn("completion_no", F.explode(upto(n)))
