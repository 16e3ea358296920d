"""Arithmetic on ``array<double>`` columns and reproducible random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13
_RANGE = float(16**_HEX_DIGITS)


def sigmoid_mask(values: Column, max_mult: float = 1.0) -> Column:
    """``max_mult * sigmoid(p)`` per entry."""
    return F.transform(values, lambda p: F.lit(float(max_mult)) / (F.lit(1.0) + F.exp(-p)))


def upto(n: Column | int) -> Column:
    """The numbers 0 to n - 1 as an array; none if n is not above zero or null."""
    last = (n if isinstance(n, Column) else F.lit(n)).cast("int") - 1
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def soft_mask(n: Column, fraction: Column) -> Column:
    """Mask of length n whose first ``fraction * n`` entries are open."""
    return F.transform(
        upto(n),
        lambda i: F.lit(1.0)
        - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (i + 1).cast("double") - fraction * n)),
    )


def vector_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.nullif(F.size(values), F.lit(0))


def vector_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))


def blend(new: Column, old: Column, keep: float) -> Column:
    """``new * (1 - keep) + keep * old`` for scalars."""
    return new * F.lit(1.0 - keep) + F.lit(float(keep)) * old


def digest(*keys: Column | str | int) -> Column:
    """Hex digest of the keys joined by colons: the same text hashes alike in any engine."""
    texts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.md5(F.concat_ws(":", *texts))


def uniform(*keys: Column | str | int) -> Column:
    """Number in the open interval (0, 1) that depends on the keys alone.

    Unlike ``rand`` it does not change with the partitioning or on a retry.
    """
    whole = F.conv(F.substring(digest(*keys), 1, _HEX_DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / _RANGE


def gaussian(*keys: Column | str | int) -> Column:
    """Standard normal number that depends on the keys alone (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*keys, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*keys, "a"))
