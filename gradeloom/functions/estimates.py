"""The unbiased pass@k estimate of the published code-generation evaluation paper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(attempts: Column, passes: Column, k: int) -> Column:
    """``1 - C(n-c, k) / C(n, k)`` as a product of k ratios; null when n < k.

    k terms, however many attempts a task has.
    """
    n, c = attempts.cast("double"), passes.cast("double")
    miss = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, j: acc * (n - c - j) / (n - j),
    )
    return F.when(attempts < k, None).when(n - c < k, F.lit(1.0)).otherwise(1.0 - miss)
