"""Aggregates over token log-probabilities that were computed elsewhere.

Tables are long: one row per (sample, position) or per (sample, position,
candidate token).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ("sample_id", "pos")
BAND = 64  # e^64 and its sums are far from the largest double


def log_softmax(
    logits: DataFrame, by: Sequence[str] = POSITION, x: str = "logit", name: str = "logp"
) -> DataFrame:
    """``x - log(sum(exp(x)))`` over the candidates of a position.

    One pass sums ``exp`` in bands of 64 below each band's own top, so nothing overflows
    and partial sums run before the shuffle; the few bands of a position are then put
    together, and the result joins back. Candidates of minus infinity add nothing.
    """
    value = F.col(x)
    band = F.floor(value / BAND)
    bands = (
        logits.where(value > F.lit(float("-inf")))
        .groupBy(*by, band.alias("_band"))
        .agg(F.sum(F.exp(value - BAND * band)).alias("_sum"))
    )
    top = F.array_max(F.col("_bands._band"))
    total = F.aggregate(
        F.col("_bands"),
        F.lit(0.0),
        lambda acc, b: acc + b["_sum"] * F.exp(F.lit(float(BAND)) * (b["_band"] - F.col("_top"))),
    )
    sums = (
        bands.groupBy(*by)
        .agg(F.collect_list(F.struct("_band", "_sum")).alias("_bands"))
        .withColumn("_top", top)
        .select(*by, (F.lit(float(BAND)) * F.col("_top") + F.log(total)).alias("_lse"))
    )
    return logits.join(sums, list(by), "left").select(*logits.columns, (value - F.col("_lse")).alias(name))


def chosen_logprobs(
    candidates: DataFrame, chosen: DataFrame, by: Sequence[str] = POSITION, token: str = "token_id"
) -> DataFrame:
    """The candidate rows of the tokens that were generated."""
    return candidates.join(chosen.select(*by, token), [*by, token])


def sequence_loglik(tokens: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Sum and mean of the chosen tokens' log-probabilities per sample."""
    return tokens.groupBy(*sample).agg(
        F.sum("logp").alias("loglik"), F.avg("logp").alias("mean_logp")
    )


def kl_to_reference(candidates: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """``sum exp(r) * (r - l)`` over positions and candidates, per sample."""
    r, l = F.col("ref_logp"), F.col("logp")
    return candidates.groupBy(*sample).agg(F.sum(F.exp(r) * (r - l)).alias("kl_div"))


def loss_terms(tokens: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Likelihood and divergence of a sample in one pass over its tokens."""
    r, l = F.col("ref_logp"), F.col("logp")
    return tokens.groupBy(*sample).agg(
        F.sum(l).alias("loglik"), F.avg(l).alias("mean_logp"), F.sum(F.exp(r) * (r - l)).alias("kl_div")
    )


def policy_loss(
    loglik: DataFrame,
    rewards: DataFrame,
    kl: DataFrame | None = None,
    kl_coefficient: float = 0.0,
    sample: str = "sample_id",
) -> DataFrame:
    """Per sample: ``pg = -loglik * reward`` and ``loss = pg + coefficient * kl``.

    The divergence comes with ``loglik`` (see :func:`loss_terms`) or as a table of its own; without
    either the loss is ``pg``.
    """
    joined = loglik.join(rewards, sample).withColumn("pg", -F.col("loglik") * F.col("reward"))
    if kl is not None:
        joined = joined.join(kl, sample)
    if "kl_div" not in joined.columns:
        return joined.withColumn("loss", F.col("pg"))
    return joined.withColumn("loss", F.col("pg") + F.lit(float(kl_coefficient)) * F.col("kl_div"))


def mean_loss(losses: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Batch means of loss and policy gradient term."""
    return losses.groupBy(*batch).agg(
        F.avg("loss").alias("loss"), F.avg("pg").alias("pg"), F.count(F.lit(1)).alias("n")
    )


def masked_nll(tokens: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Negative log-likelihood of the masked-in tokens and how many there are."""
    taken = F.coalesce(F.col("mask"), F.lit(False))
    return tokens.groupBy(*sample).agg(
        F.coalesce(F.sum(F.when(taken, -F.col("logp"))), F.lit(0.0)).alias("sum_nll"),
        F.count_if(taken).alias("num_considered_tokens"),
    )
