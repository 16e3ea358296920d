"""Histories of runs: best so far, step series, running means between resets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeloom.operators.positions import BLOCK_ROWS, block_of, running, with_position


def best_so_far(
    history: DataFrame,
    run: Sequence[str],
    step: str,
    valid: str = "valid_acc",
    carried: Sequence[str] = ("test_acc",),
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Best validation score up to each step and the other scores at that step.

    The start is 0.0 for all of them and only a strictly better score replaces
    it, so the earliest of equal scores stays. This is one running maximum over
    (score, minus step, scores to carry).
    """
    score = F.col(valid)
    candidate = F.when(
        (score > 0) & ~F.isnan(score),
        F.struct(
            score.cast("double").alias("score"),
            (-F.col(step)).alias("order"),
            *[F.col(c).cast("double").alias(c) for c in carried],
        ),
    )
    out = running(history, run, [step], {"_best": ("max", candidate)}, width=width)
    return out.select(
        *history.columns,
        F.coalesce(F.col("_best.score"), F.lit(0.0)).alias("best_val_acc"),
        *[
            F.when(F.col("_best").isNull(), F.lit(0.0))
            .otherwise(F.col(f"_best.{c}"))
            .alias(f"{c.removesuffix('_acc')}_at_best_val")
            for c in carried
        ],
    ).drop("_best")


def step_records(
    history: DataFrame, metrics: DataFrame | None = None, width: int = BLOCK_ROWS
) -> DataFrame:
    """The log of a run: (run, iter, metric, value), one row per scalar and step.

    ``history(run, iter, valid_acc, test_acc, ...)`` holds the scores of every
    evaluation step; the best validation score so far and the test (and transfer)
    scores at it are added. ``metrics(run, iter, metric, value)`` are further
    scalars, such as running means.
    """
    carried = [c for c in ("test_acc", "transfer_acc") if c in history.columns]
    wide = best_so_far(history, ["run"], "iter", "valid_acc", carried, width)
    scalars = [c for c in wide.columns if c not in ("run", "iter")]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in scalars
        ]
    )
    records = wide.select("run", "iter", F.inline(pairs))
    return records if metrics is None else records.unionByName(metrics)


def step_series(
    log: DataFrame,
    metric: str,
    node: str = "node",
    path: str = "path",
    place: str = "pos",
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """(node, step, value, at_start) of one metric, in path order.

    Steps count all rows of a node, also those without the metric, which are
    dropped afterwards.
    """
    needed = log.select(node, path, place, "iter", F.col(metric).alias("_metric"))
    # A file is one block, or several where its records are many: each counts its own, and the
    # counts of the blocks before it in the node are added.
    blocks = F.struct(F.col(path), block_of(F.col(place), width))
    placed = with_position(needed, [path, place], [node], "step", blocks)
    value = F.col("_metric").cast("double")
    return placed.where(value.isNotNull() & ~F.isnan(value)).select(
        node, "step", value.alias("value"), (F.col("iter") == 0).alias("at_start")
    )


def present(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null nor nan."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))


def running_mean(
    log: DataFrame,
    metric: Sequence[str],
    order: str,
    value: str = "value",
    reset: str = "reset",
    sets: str | None = None,
    bias: float = 1e-8,
    name: str = "running_mean",
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean since the last reset; without a sample since then, the last mean before it.

    ``reset`` marks rows after which the sums start anew: a logger reports first
    and resets afterwards. A row marked by ``sets`` replaces what was summed so
    far by its own value, counted once. ``bias`` is the small start of the count
    that avoids a division by zero; it does not apply after a set.

    A segmented scan: rows are summed inside their epoch and block in one layout, and one
    summary per block is carried over the blocks before it. The input is read twice, once for
    the summaries.
    """
    work = log.select(
        "*",
        F.struct(*metric).alias("_group"),
        F.struct(block_of(F.col(order), width).alias("number")).alias("_block"),
        (F.lit(False) if sets is None else F.coalesce(F.col(sets), F.lit(False))).alias("_set"),
    )
    breaks = F.col(reset).cast("bigint") + F.col("_set").cast("bigint")
    so_far = W.partitionBy("_group", "_block").orderBy(order)
    before = F.sum(breaks).over(so_far.rowsBetween(W.unboundedPreceding, -1))
    # Epochs of a block, from 0; epoch 0 goes on from the block before and holds no set.
    work = work.withColumn("_epoch", F.coalesce(before, F.lit(0)) + F.col("_set").cast("bigint"))
    carried = _carried_means(work, value, breaks, bias)
    in_epoch = W.partitionBy("_group", "_block", "_epoch").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    here = work.select(
        "*",
        F.sum(value).over(in_epoch).alias("_sum"),
        F.count(value).over(in_epoch).alias("_n"),
        F.max("_set").over(in_epoch).alias("_was_set"),
    ).join(carried, ["_group", "_block"])
    goes_on = F.col("_epoch") == 0
    total = F.coalesce("_sum", F.lit(0.0)) + F.when(goes_on, F.col("_carry.sum")).otherwise(0.0)
    count = F.col("_n") + F.when(goes_on, F.col("_carry.n")).otherwise(0)
    was_set = F.col("_was_set") | (goes_on & F.col("_carry.was_set"))
    means = here.withColumn("_mean", _mean(total, count, was_set, bias))
    latest = F.last("_mean", ignorenulls=True).over(so_far.rowsBetween(W.unboundedPreceding, 0))
    return means.select(
        *log.columns, F.coalesce(latest, F.col("_carry.mean"), F.lit(0.0)).alias(name)
    )


def _mean(total: Column, count: Column, was_set: Column, bias: float) -> Column:
    """Mean of an epoch, null without a sample; the biased start does not apply after a set."""
    return F.when(count >= 1, total / (count + F.when(was_set, 0.0).otherwise(bias)))


def _carried_means(work: DataFrame, value: str, breaks: Column, bias: float) -> DataFrame:
    """(_group, _block, _carry): the open epoch and the last mean before each block.

    A block's summary is its first epoch, its last one (open to the right) and its last mean that
    needs nothing from before. Summaries combine like the rows do, so the scan over the
    blocks of a group is the same segmented sum, on one row per block.
    """
    epochs = work.groupBy("_group", "_block", "_epoch").agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        F.count(value).alias("n"),
        F.max("_set").alias("was_set"),
        F.sum(breaks).alias("breaks"),
    )
    part = F.struct("sum", "n", "was_set")
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("was_set"))
    own = _mean(F.col("sum"), F.col("n"), F.col("was_set"), bias)
    blocks = epochs.groupBy("_group", "_block").agg(
        F.sum("breaks").alias("breaks"),
        F.coalesce(F.max(F.when(F.col("_epoch") == 0, part)), none).alias("first"),
        F.max(F.struct(F.col("_epoch").alias("epoch"), part.alias("state"))).alias("last"),
        F.max(
            F.when((F.col("_epoch") > 0) & own.isNotNull(), F.struct(F.col("_epoch").alias("epoch"), own.alias("mean")))
        )["mean"].alias("own_mean"),
    )
    in_order = W.partitionBy("_group").orderBy("_block")
    # What stands open behind a block: its last epoch, unless a reset at its end closed that too.
    open_state = F.when(F.col("last.epoch") == F.col("breaks"), F.col("last.state")).otherwise(none)
    numbered = blocks.select(
        "*",
        open_state.alias("open"),
        F.sum((F.col("breaks") > 0).cast("bigint")).over(in_order.rowsBetween(W.unboundedPreceding, 0)).alias("segment"),
    )
    segment = W.partitionBy("_group", "segment").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    behind = numbered.select(
        "*",
        F.struct(
            F.sum("open.sum").over(segment).alias("sum"),
            F.sum("open.n").over(segment).alias("n"),
            F.max("open.was_set").over(segment).alias("was_set"),
        ).alias("behind"),
    )
    entered = behind.withColumn("enter", F.coalesce(F.lag("behind").over(in_order), none))
    first_mean = _mean(
        F.col("first.sum") + F.col("enter.sum"), F.col("first.n") + F.col("enter.n"), F.col("enter.was_set"), bias
    )
    latest = F.last(F.coalesce("own_mean", first_mean), ignorenulls=True)
    return entered.select(
        "_group",
        "_block",
        F.struct(
            "enter.sum",
            "enter.n",
            "enter.was_set",
            latest.over(in_order.rowsBetween(W.unboundedPreceding, -1)).alias("mean"),
        ).alias("_carry"),
    )
