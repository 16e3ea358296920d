"""Population search on tables: sampling members, elite moments, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.vectors import blend, gaussian, uniform, upto


def _members(dimensions: DataFrame, size: int) -> DataFrame:
    """Every dimension once for each of the ``size`` members."""
    return dimensions.withColumn("member", F.explode(upto(size)))


def _with_best(value: Column, keep_best: bool) -> Column:
    if not keep_best:
        return value
    return F.when(F.col("member") == 0, F.col("best")).otherwise(value)


def uniform_population(
    best: DataFrame, size: int, low: float, high: float, seed: int | str, keep_best: bool = True
) -> DataFrame:
    """(member, i, value) uniform in [low, high); member 0 is ``best(i, best)``."""
    drawn = F.lit(low) + uniform(seed, F.col("member"), F.col("i")) * F.lit(high - low)
    return _members(best, size).select("member", "i", _with_best(drawn, keep_best).alias("value"))


def gaussian_population(
    moments: DataFrame, size: int, low: float, high: float, seed: int | str, keep_best: bool = True
) -> DataFrame:
    """(member, i, value) normal around ``moments(i, mean, std, best)``, clamped to [low, high]."""
    drawn = F.col("mean") + F.col("std") * gaussian(seed, F.col("member"), F.col("i"))
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), drawn))
    return _members(moments, size).select(
        "member", "i", _with_best(clamped, keep_best).alias("value")
    )


def elite_moments(population: DataFrame, elite: DataFrame) -> DataFrame:
    """Mean and sample deviation per dimension over the elites; one elite gives null."""
    chosen = population.join(elite.select("member"), "member", "left_semi")
    return chosen.groupBy("i").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def blended_moments(new: DataFrame, old: DataFrame, keep: float) -> DataFrame:
    """``new * (1 - keep) + keep * old`` for mean and deviation, per dimension."""
    before = old.select("i", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return new.join(before, "i").select(
        "i",
        blend(F.col("mean"), F.col("_mean"), keep).alias("mean"),
        blend(F.col("std"), F.col("_std"), keep).alias("std"),
    )


def blended_best(
    population: DataFrame, best: DataFrame, member: DataFrame, keep: float
) -> DataFrame:
    """The best member's vector blended into the best vector so far (uniform search)."""
    values = population.join(F.broadcast(member.select("member")), "member", "left_semi")
    return values.join(best, "i").select(
        "i", blend(F.col("value"), F.col("best"), keep).alias("best")
    )


def member_likelihood(members: DataFrame, sample_ll: DataFrame) -> DataFrame:
    """Mean log-likelihood over a member's correct samples, 0.0 when it has none.

    ``sample_ll(member, mean_lp, correct)``.
    """
    means = sample_ll.where("correct").groupBy("member").agg(F.avg("mean_lp").alias("_ll"))
    return members.join(means, "member", "left").select(
        *members.columns, F.coalesce("_ll", F.lit(0.0)).alias("mean_ll")
    )
