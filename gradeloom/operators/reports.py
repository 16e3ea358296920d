"""Aggregated reports: accuracy, pass@k, rewards, routed totals, metric bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.estimates import pass_at_k as pass_estimate
from gradeloom.functions.vectors import vector_mean, vector_norm
from gradeloom.operators.positions import chunk_of, data_blocks, with_position


def accuracy(correct: Column) -> Column:
    """Share of correct rows; a missing grade counts as wrong, no rows give null."""
    return F.avg(F.coalesce(correct, F.lit(False)).cast("double"))


def accuracy_report(details: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sample count and accuracy, overall or per group."""
    return details.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), accuracy(F.col("correct")).alias("acc")
    )


def language_report(
    details: DataFrame, languages: Sequence[str], prefix: str = "lang_", threshold: float = 0.5
) -> DataFrame:
    """Overall accuracy and, per language, the share of all samples correct in it."""
    aggs = [accuracy(F.col("correct")).alias("acc")]
    for lang in languages:
        fluent = F.col(f"{prefix}{lang}") > threshold
        aggs.append(accuracy(F.col("correct") & fluent).alias(f"acc_{lang}"))
    return details.agg(*aggs)


def metric_bundle(
    df: DataFrame, value: Column, prefix: str | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Mean, population deviation, minimum and maximum as (metric, value) rows."""
    name = F.lit(prefix) if isinstance(prefix, str) else prefix
    wide = df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    pairs = F.array(
        *[
            F.struct(
                F.concat(name, F.lit(f"/{stat}")).alias("metric"),
                F.col(stat).cast("double").alias("value"),
            )
            for stat in ("mean", "std", "min", "max")
        ]
    )
    return wide.select(*by, F.inline(pairs))


def attempts_per_task(
    verdicts: DataFrame, flags: dict[str, Column], task: str = "task_id"
) -> DataFrame:
    """Number of attempts and, per flag, how many of them have it."""
    return verdicts.groupBy(task).agg(
        F.count(F.lit(1)).alias("attempts"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
    )


def pass_at_k_report(
    per_task: DataFrame, passes: Sequence[str], ks: Sequence[int] = (1, 10, 100), prefix: str = ""
) -> DataFrame:
    """Mean pass@k over tasks, for each k that every task has enough attempts for."""
    wide = per_task.agg(
        F.min("attempts").alias("least"),
        *[
            F.avg(pass_estimate(F.col("attempts"), F.col(name), k)).alias(f"{name}@{k}")
            for name in passes
            for k in ks
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{prefix}{name}_pass@{k}").alias("metric"),
                F.lit(k).alias("k"),
                F.col(f"{name}@{k}").alias("value"),
            )
            for name in passes
            for k in ks
        ]
    )
    return (
        wide.select("least", F.inline(rows)).where(F.col("k") <= F.col("least")).drop("least")
    )


def numbered_attempts(
    completions: DataFrame, task: str, ordinal: str, name: str = "completion_id"
) -> DataFrame:
    """Arrival number of each completion within its task, from 0.

    Ordinals may be dense or have any gaps: their ranges are cut by the rows in them, which reads the column at once.
    """
    return with_position(completions, [ordinal], [task], name, data_blocks(completions, ordinal))


def verdict_lists(verdicts: DataFrame, task: str = "task_id") -> DataFrame:
    """Statuses per task, one row per completion, with the task's number of completions.

    The same shape however many completions a task has: no list to outgrow a row.
    """
    files = verdicts.groupBy(task).agg(F.count(F.lit(1)).alias("nfiles"))
    rows = verdicts.select(
        task, "completion_id", F.col("base_status").alias("base"), F.col("plus_status").alias("plus")
    )
    return rows.join(files, task)


def with_verdict_counts(details: DataFrame, per_task: DataFrame, task: str = "task_id") -> DataFrame:
    """Verdict counts of the task on each detail row; zero, and ``has_verdicts`` false, where it has none."""
    counted = per_task.withColumn("has_verdicts", F.lit(True))
    zero = {c: 0 for c in per_task.columns if c != task}
    return details.join(counted, task, "left").fillna(zero | {"has_verdicts": False}, [*zero, "has_verdicts"])


def routed_report(graded: DataFrame, label: str = "expert_label") -> DataFrame:
    """Per expert: samples and accuracy; and the total over *all* samples.

    Samples without an expert are not graded but stay in the denominator.
    ``graded`` holds every sample once, with ``evaluated`` and ``correct``.
    """
    hits = F.coalesce(F.col("correct"), F.lit(False)).cast("int")
    whole = F.grouping(label) == 1
    # Labels and the total in one pass; a missing label is a group of its own.
    rolled = graded.rollup(label).agg(
        whole.alias("_whole"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("evaluated"), 1).otherwise(0)).alias("_asked"),
        F.sum(F.when(F.col("evaluated"), hits).otherwise(0)).alias("hits"),
    )
    return rolled.where(F.col("_whole") | (F.col("_asked") > 0)).select(
        F.when(F.col("_whole"), "final_test_acc").otherwise(F.col(label)).alias(label),
        F.when(F.col("_whole"), F.col("n")).otherwise(F.col("_asked")).alias("num_samples"),
        F.try_divide("hits", F.when(F.col("_whole"), F.col("n")).otherwise(F.col("_asked"))).alias("test_acc"),
    )


def normalized_rewards(
    df: DataFrame,
    batch: Sequence[str],
    reward: str = "reward",
    clip: float | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Rewards centred and scaled over their batch, then clipped.

    The two moments come from one aggregate per batch that joins back, so a
    large batch is never gathered in one place.
    """
    out = F.col(reward)
    if normalize:
        named = [F.col(c).alias(f"_of_{c}") for c in batch]
        moments = df.groupBy(*named).agg(
            F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std")
        )
        # Rows without a batch are a batch of their own.
        same = reduce(and_, (df[c].eqNullSafe(moments[f"_of_{c}"]) for c in batch))
        df = df.join(moments, same).drop(*[f"_of_{c}" for c in batch])
        out = (out - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(1e-7))
    if clip is not None and clip > 0:
        out = F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), out))
    return df.withColumn("norm_reward", out).drop("_mean", "_std")


def vector_stats(params: DataFrame, values: str = "values") -> DataFrame:
    """Mean and length of every named vector."""
    return params.select(
        *[c for c in params.columns if c != values],
        vector_mean(F.col(values)).alias("mean"),
        vector_norm(F.col(values)).alias("norm"),
    )


def mean_weight_per_expert(coefficients: DataFrame) -> DataFrame:
    """Mean mix weight of each expert over the named vectors."""
    return coefficients.groupBy("expert").agg(F.avg("weight").alias("mean_weight"))


def changed_rows(df: DataFrame, old: str, new: str) -> DataFrame:
    """How many texts cleaning changed, and how many there are."""
    return df.agg(
        F.count_if(~F.col(old).eqNullSafe(F.col(new))).alias("changed"),
        F.count(F.lit(1)).alias("total"),
    )


def sample_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_samples"))
