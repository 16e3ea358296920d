"""Choosing members of a population: the best one, and the elites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.positions import with_sort_position


def best_member(performance: DataFrame, perf: str = "perf", member: str = "member") -> DataFrame:
    """The member with the highest performance, the first of equals."""
    return performance.orderBy(F.desc(perf), F.asc(member)).limit(1)


def best_member_by_likelihood(
    performance: DataFrame, perf: str = "perf", ll: str = "mean_ll", member: str = "member"
) -> DataFrame:
    """Best performance, ties by mean log-likelihood, then the first."""
    return performance.orderBy(F.desc(perf), F.desc(ll), F.asc(member)).limit(1)


def elites(
    performance: DataFrame, ratio: float, perf: str = "perf", member: str = "member"
) -> DataFrame:
    """The top ``int(ratio * size)`` members, ties by member number.

    No elites at all is an error here. The number of elites grows with the
    population, so this sorts across partitions instead of taking a limit.
    """
    wanted = int(ratio * performance.count())
    if wanted < 1:
        raise ValueError(f"ratio {ratio} selects no member of this population")
    ranked = with_sort_position(performance, [F.desc(perf), F.asc(member)], "_rank")
    return ranked.where(F.col("_rank") < wanted).drop("_rank")
