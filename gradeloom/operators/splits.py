"""Selections, splits, shards and samples by position or by seeded hash."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.vectors import digest, upto
from gradeloom.operators.positions import first_k_per_group, with_hash_position


def pick_positions(df: DataFrame, picked: DataFrame | None, ordinal: str = "ordinal") -> DataFrame:
    """Rows at the listed positions, a position listed twice giving two rows; all if None."""
    return df if picked is None else df.join(picked.select(ordinal), ordinal)


def parity_split(ordinal: Column) -> Column:
    """Even positions train, odd ones validate."""
    return F.when(ordinal % 2 == 0, "train").otherwise("valid")


def four_to_one_split(ordinal: Column) -> Column:
    """Four of five positions train, the fifth tests."""
    return F.when(ordinal % 5 < 4, "train").otherwise("test")


def parity_position(ordinal: Column) -> Column:
    """Position inside its own half of the parity split."""
    return F.floor(ordinal / 2).cast("bigint")


def four_to_one_position(ordinal: Column) -> Column:
    """Position inside its own part of the four-to-one split."""
    block = F.floor(ordinal / 5).cast("bigint")
    return F.when(ordinal % 5 < 4, block * 4 + ordinal % 5).otherwise(block)


def tail_holdout(
    df: DataFrame, n: int, held: int = 256, ordinal: str = "ordinal"
) -> DataFrame:
    """The first n rows, of which the last ``held`` validate. Fewer than n rows is an error."""
    have = df.count()
    if n > have:
        raise ValueError(f"asked for the first {n} rows of a table of {have}")
    place = F.col(ordinal)
    return df.where(place < n).withColumn(
        "split", F.when(place >= n - held, "valid").otherwise("train")
    )


def cut_split(ordinal: Column, at: int, first: str = "train", rest: str = "test") -> Column:
    """Everything before a position, and everything from it on."""
    return F.when(ordinal < at, first).otherwise(rest)


def seeded_split(
    df: DataFrame,
    key: str,
    seed: int | str,
    k: int,
    name: str = "shuffled",
    group: Sequence[str] = (),
) -> DataFrame:
    """Seeded shuffle: the first k rows (of each group) train, all others validate.

    A deterministic uniform permutation by digest, not the one of a particular
    random generator. ``name`` holds the place in the shuffle.
    """
    placed = with_hash_position(df, key, seed, name, group)
    return placed.withColumn("split", cut_split(F.col(name), k, "train", "valid"))


def equal_shards(
    df: DataFrame, key: str, seed: int | str, n_parts: int = 11, n_keep: int = 10
) -> DataFrame:
    """Shards of size ``total // n_parts`` after a seeded shuffle; the first ``n_keep`` stay."""
    rows = df.count()
    size = rows // n_parts
    if size == 0:
        raise ValueError(f"fewer rows than the {n_parts} parts asked for")
    placed = with_hash_position(df, key, seed, "_place", rows=rows)
    shard = F.floor(F.col("_place") / size).cast("int")
    return placed.withColumn("shard", shard).where(F.col("shard") < n_keep).drop("_place")


def cap_per_source(df: DataFrame, source: str, ordinal: str, cap: int = 400) -> DataFrame:
    """At most ``cap - 1`` rows per source: counting stops when the cap is reached."""
    return first_k_per_group(df, [source], [ordinal], cap - 1)


ROUNDS = 6
#: Round functions are squares modulo this prime, so that products fit 64 bits in any engine.
PRIME = (1 << 31) - 1


def _round_keys(seed: int | str, step: Column, rows: int, columns: int) -> Column:
    """For each round of a step's permutation two numbers below 2^28 and the size of the half that moves."""

    def of_round(number: int) -> Column:
        words = digest(seed, step, number)
        first, second = (F.conv(F.substring(words, at, 7), 16, 10).cast("bigint") for at in (1, 8))
        size = F.lit(rows if number % 2 == 0 else columns).cast("bigint")
        return F.struct(first.alias("a"), second.alias("b"), size.alias("size"))

    return F.array(*[of_round(number) for number in range(ROUNDS)])


def _permuted(j: Column, keys: Column, columns: int) -> Column:
    """Where a keyed permutation of 0 ... rows * columns - 1 puts j.

    Feistel rounds on j's row and column, in whole-number arithmetic. A fold over the rounds,
    as nested bindings would make Spark resolve their types again and again at every level.
    """

    def squared(x: Column) -> Column:
        return (x * x) % PRIME

    def round_of(halves: Column, key: Column) -> Column:
        mixed = squared((squared((halves["still"] + key["a"]) % PRIME) + key["b"]) % PRIME)
        return F.struct(
            halves["still"].alias("moving"), ((halves["moving"] + mixed) % key["size"]).alias("still")
        )

    start = F.struct(
        F.call_function("div", j, F.lit(columns).cast("bigint")).alias("moving"), (j % columns).alias("still")
    )
    return F.aggregate(keys, start, round_of, lambda halves: halves["moving"] * columns + halves["still"])


def _walked(place: Column, n: int, again: Callable[[Column], Column], most: int) -> Column:
    """``place``, permuted again until it is below n; that takes ``most`` times at most.

    Two nested folds, because a fold has no early end: the inner one starts only where the
    place is still outside.
    """
    turns = F.sequence(F.lit(1), F.lit(math.isqrt(most) + 1))

    def once(at: Column, _: Column) -> Column:
        return F.when(at < n, at).otherwise(again(at))

    def many(at: Column, _: Column) -> Column:
        return F.when(at < n, at).otherwise(F.aggregate(turns, at, once))

    return F.when(place < n, place).otherwise(F.aggregate(turns, place, many))


def step_draws(n: int, steps: DataFrame, size: int, seed: int | str) -> DataFrame:
    """Positions drawn at random for every step without replacement: ``(step, draw, ordinal)``.

    Draw j of a step is the place that the step's own permutation, keyed by (seed, step),
    gives to j. The permutation covers the rows and columns of a rectangle that has fewer than
    sqrt(n) + 1 places too many; one that lands outside walks on along its cycle until it
    is inside again, so the n positions are permuted among themselves. Hardly any draw walks, and
    the cost of a step is its batch, whatever n is.
    """
    rows = math.isqrt(max(n - 1, 0)) + 1
    columns = max(1, -(-n // rows))
    # Keys first, in a step of their own: beside the explode they would be made for every draw.
    keyed = steps.select("step", _round_keys(seed, F.col("step"), rows, columns).alias("_keys"))
    drawn = keyed.select("step", "_keys", F.explode(upto(min(size, n))).alias("draw"))
    again = lambda at: _permuted(at, F.col("_keys"), columns)
    first = drawn.withColumn("_place", again(F.col("draw").cast("bigint")))
    place = _walked(F.col("_place"), n, again, rows * columns - n + 1)
    # Never null, and said so: else a join on it filters by the whole expression first.
    return first.select("step", "draw", F.coalesce(place, F.lit(-1)).alias("ordinal"))


def random_batch(
    df: DataFrame, size: int, seed: int | str, step: int = 0, ordinal: str = "ordinal", n: int | None = None
) -> DataFrame:
    """The batch of one step, as :func:`step_batches` draws it."""
    steps = df.sparkSession.range(1).select(F.lit(step).alias("step"))
    return step_batches(df, steps, size, seed, ordinal, n)


def step_batches(
    df: DataFrame,
    steps: DataFrame,
    size: int,
    seed: int | str,
    ordinal: str = "ordinal",
    n: int | None = None,
) -> DataFrame:
    """One random batch per step over a table with dense positions; it is counted unless ``n`` says how many."""
    draws = step_draws(df.count() if n is None else n, steps, size, seed)
    return draws.join(df, draws["ordinal"] == df[ordinal]).drop(draws["ordinal"])


def head_of_split(df: DataFrame, split: str, n: int = 256, ordinal: str = "split_ordinal") -> DataFrame:
    """The first n rows of one split, by position inside the split."""
    return df.where((F.col("split") == split) & (F.col(ordinal) < n))


def complement(df: DataFrame, taken: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key was not taken."""
    return df.join(taken.select(*key), list(key), "left_anti")


def choose_split(
    df: DataFrame, split: str, metrics: dict[str, str]
) -> tuple[DataFrame, str]:
    """Rows of the evaluated split and the name of the metric to report for it."""
    if split not in metrics:
        raise ValueError(f"no metric for split {split!r}; known: {sorted(metrics)}")
    return df.where(F.col("split") == split), metrics[split]


def split_overlap(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """How many keys are in both splits."""
    flags = df.groupBy(key).agg(
        F.max((F.col("split") == left).cast("int")).alias("l"),
        F.max((F.col("split") == right).cast("int")).alias("r"),
    )
    return flags.agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("overlap"))
