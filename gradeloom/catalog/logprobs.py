"""Token log-probabilities: a line item is one token of the order it belongs to.

The sample is the order, the position is the line number, and the candidates at
a position are the items that share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog.registry import query, table
from gradeloom.functions.grade import reward
from gradeloom.operators import logprobs

_KEYS = ["sample_id", "pos", "token_id", "supplier"]
_TOKENS = """
    t AS (SELECT l_orderkey AS sample_id, l_linenumber AS pos, l_partkey AS token_id, l_suppkey AS supplier,
                 l_quantity / 10 AS logit, -(1 + l_quantity / 10) AS logp, -(1 + l_discount * 20) AS ref_logp,
                 l_returnflag = 'A' AS chosen, l_linestatus = 'O' AS mask FROM lineitem)
"""


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("token_id"),
        F.col("l_suppkey").alias("supplier"),
        (F.col("l_quantity") / 10).alias("logit"),
        (-(1 + F.col("l_quantity") / 10)).alias("logp"),
        (-(1 + F.col("l_discount") * 20)).alias("ref_logp"),
        (F.col("l_returnflag") == "A").alias("chosen"),
        (F.col("l_linestatus") == "O").alias("mask"),
    )


@query(
    f"""
    WITH {_TOKENS}, m AS (SELECT *, max(logit) OVER (PARTITION BY sample_id) AS peak FROM t)
    SELECT sample_id, pos, token_id, supplier,
           round(logit - peak - ln(sum(exp(logit - peak)) OVER (PARTITION BY sample_id)), 6) + 0.0 AS logp FROM m
    """
)
def log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """All items of an order compete for one position."""
    logits = _tokens(spark, sf).select(*_KEYS, "logit")
    soft = logprobs.log_softmax(logits, ["sample_id"])
    return soft.select(*_KEYS, F.round("logp", 6).alias("logp"))


@query(
    f"""
    WITH {_TOKENS}
    SELECT sample_id, round(sum(logp), 6) AS loglik, round(avg(logp), 6) AS mean_logp
    FROM t WHERE chosen GROUP BY sample_id
    """
)
def sequence_loglik(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _tokens(spark, sf)
    by = ["sample_id", "pos", "supplier"]
    chosen = logprobs.chosen_logprobs(tokens, tokens.where("chosen").distinct(), by)
    sums = logprobs.sequence_loglik(chosen.where("chosen"))
    return sums.select("sample_id", F.round("loglik", 6).alias("loglik"), F.round("mean_logp", 6).alias("mean_logp"))


@query(
    f"""
    WITH {_TOKENS}
    SELECT sample_id, round(sum(exp(ref_logp) * (ref_logp - logp)), 6) + 0.0 AS kl_div FROM t GROUP BY sample_id
    """
)
def kl_to_reference(spark: SparkSession, sf: str) -> DataFrame:
    kl = logprobs.kl_to_reference(_tokens(spark, sf))
    return kl.withColumn("kl_div", F.round("kl_div", 6))


_LOSSES = f"""
    {_TOKENS},
    s AS (SELECT sample_id, sum(logp) AS loglik, sum(exp(ref_logp) * (ref_logp - logp)) AS kl_div FROM t GROUP BY sample_id),
    l AS (SELECT sample_id, o_orderstatus, -loglik * r AS pg, -loglik * r + 0.2 * kl_div AS loss
          FROM s JOIN (SELECT o_orderkey AS sample_id, o_orderstatus,
                              CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END AS r FROM orders) USING (sample_id))
"""


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _tokens(spark, sf)
    rewards = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        "o_orderstatus",
        reward(F.col("o_orderstatus") == "F").alias("reward"),
    )
    return logprobs.policy_loss(logprobs.loss_terms(tokens), rewards, kl_coefficient=0.2)


@query(f"WITH {_LOSSES} SELECT sample_id, round(pg, 6)::DOUBLE + 0.0 AS pg, round(loss, 6)::DOUBLE + 0.0 AS loss FROM l")
def policy_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _losses(spark, sf).select(
        "sample_id", F.round("pg", 6).alias("pg"), F.round("loss", 6).alias("loss")
    )


@query(
    f"""
    WITH {_LOSSES}
    SELECT o_orderstatus, round(avg(loss), 6) + 0.0 AS loss, round(avg(pg), 6) + 0.0 AS pg, count(*) AS n FROM l GROUP BY o_orderstatus
    """
)
def mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    means = logprobs.mean_loss(_losses(spark, sf), ["o_orderstatus"])
    return means.withColumns({"loss": F.round("loss", 6), "pg": F.round("pg", 6)})


@query(
    f"""
    WITH {_TOKENS}
    SELECT sample_id, round(coalesce(sum(-logp) FILTER (mask), 0), 6) AS sum_nll,
           count(*) FILTER (mask) AS num_considered_tokens FROM t GROUP BY sample_id
    """
)
def masked_nll(spark: SparkSession, sf: str) -> DataFrame:
    nll = logprobs.masked_nll(_tokens(spark, sf))
    return nll.withColumn("sum_nll", F.round("sum_nll", 6))
