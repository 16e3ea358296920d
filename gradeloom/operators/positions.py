"""Positions, ranks and running values without ever putting a group in one task.

A group (one task, one run, one source) may hold a large share of all rows. Rows
are therefore handled in *blocks*, ranges of the order column inside a group:

1. the running value inside each block (one window per block);
2. one total per block, carried over the earlier blocks of its group;
3. carry and inner value combined.

A block of an integer order column is ``BLOCK_ROWS`` wide, so with unique orders
it holds at most that many rows whatever the size of its group. Step 2 sees one
row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeloom.functions.vectors import digest
from gradeloom.session import cut_lineage

BLOCK_ROWS = 1 << 18
#: Cells of the histogram that :func:`data_blocks` cuts ranges by.
CELLS = 4096
#: Hex digits of a digest that fit a whole number.
MOST_DIGITS = 15
_FOLD = {"sum": F.sum, "max": F.max}


def block_of(order: Column, width: int = BLOCK_ROWS) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    block: Column | None = None,
    width: int = BLOCK_ROWS,
    inclusive: bool = True,
    levels: int = 1,
) -> DataFrame:
    """Add running values per group in the given order.

    ``values`` maps an output name to ``("sum" | "max", expression)``. With
    ``inclusive=False`` a row sees the rows before it only (null for the first).
    ``block`` must grow with the order; by default it is ranges of the first order
    column, ``width`` wide.

    A group has as many blocks as its order range is wide, divided by ``width``; for orders
    with gaps :func:`data_blocks` gives ranges by rows instead. Where the blocks are
    themselves too many for one task, ``levels=2`` carries the totals over blocks of blocks;
    blocks that are given must be whole numbers then.

    The input is read twice, once with few columns for the block totals. Give it a
    stored table, or cut the lineage first, where computing it again is dear; and
    give it narrow rows where only the positions of wide ones are wanted.
    """
    key, blk = "_group", "_block"
    blocks = block_of(F.col(order[0]), width) if block is None else block
    work = df.select(
        "*",
        F.struct(*[F.col(g) for g in group] or [F.lit(0).alias("all")]).alias(key),
        # As a struct, like the group: rows without an order are a block of their own.
        F.struct(blocks.alias("number")).alias(blk),
        *[expr.alias(f"_in_{name}") for name, (_, expr) in values.items()],
    )
    end = W.currentRow if inclusive else -1
    inner = W.partitionBy(key, blk).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    totals = work.groupBy(key, blk).agg(
        *[_FOLD[kind](f"_in_{name}").alias(name) for name, (kind, _) in values.items()]
    )
    if levels > 1:
        numbered = totals.select(
            F.col(key).alias("g"), F.col(blk).alias("b"), F.col(f"{blk}.number").alias("n"),
            *[F.col(name).alias(f"_total_{name}") for name in values],
        )
        again = {name: (kind, F.col(f"_total_{name}")) for name, (kind, _) in values.items()}
        summed = running(numbered, ["g"], ["n"], again, None, width, False, levels - 1)
        carried = summed.select(
            F.col("g").alias(key), F.col("b").alias(blk),
            *[F.col(name).alias(f"_carry_{name}") for name in values],
        )
    else:
        before = W.partitionBy(key).orderBy(blk).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(
            key,
            blk,
            *[
                _FOLD[kind](name).over(before).alias(f"_carry_{name}")
                for name, (kind, _) in values.items()
            ],
        )
    inside = work.select(
        "*",
        *[
            _FOLD[kind](f"_in_{name}").over(inner).alias(f"_here_{name}")
            for name, (kind, _) in values.items()
        ],
    )

    def combined(name: str, kind: str) -> Column:
        carry, here = F.col(f"_carry_{name}"), F.col(f"_here_{name}")
        both = carry + here if kind == "sum" else F.greatest(carry, here)
        return F.coalesce(both, carry, here).alias(name)

    return inside.join(carried, [key, blk]).select(
        *[F.col(c) for c in df.columns],
        *[combined(name, kind) for name, (kind, _) in values.items()],
    )


def with_position(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "ordinal",
    block: Column | None = None,
    width: int = BLOCK_ROWS,
    levels: int = 1,
) -> DataFrame:
    """0-based position of each row, in its group or in the whole table.

    The first order column is an integer that, with the others, is unique in its
    group (or ``block`` says how to cut the order into bounded ranges).
    """
    one = {name: ("sum", F.lit(1).cast("bigint"))}
    counted = running(df, group, order, one, block, width, levels=levels)
    return counted.withColumn(name, F.col(name) - 1)


def with_sort_position(
    df: DataFrame, order: Sequence[Column], name: str = "ordinal", group: Sequence[str] = ()
) -> DataFrame:
    """0-based position under any total order, also on texts and doubles; in the
    whole table or in each group.

    Rows are range-partitioned and sorted once and that layout is checkpointed,
    so the passes below (count per partition, number, first of each group) read
    the very same partitions also after an executor was lost. A hot group is cut
    by the ranges like everything else.
    """
    keys = [F.col(g) for g in group]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    fixed = cut_lineage(spread).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    counts = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition: small however large the table is.
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_rows").over(
                W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    placed = (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )
    if not group:
        return placed
    keyed = placed.withColumn("_group", F.struct(*keys))
    firsts = keyed.groupBy("_group").agg(F.min(name).alias("_first"))
    return (
        keyed.join(firsts, "_group")
        .withColumn(name, F.col(name) - F.col("_first"))
        .drop("_group", "_first")
    )


def data_blocks(df: DataFrame, order: str, width: int = BLOCK_ROWS, cells: int = CELLS) -> Column:
    """Blocks of a whole-number order by its rows, about ``width`` or fewer each, for dense, sparse and hashed numbers.

    Reads the order column twice at once: its range, then rows, least and greatest number in each of
    ``cells`` equal parts of it, which are all that comes to the driver. Neighbouring parts with few
    rows share a block, and full ones are cut evenly between their own least and greatest number, so
    there are some 4 rows / width + 2 blocks at most, whatever the gaps. Only equal numbers, and crowds
    inside a part that holds far numbers as well, can make a block larger.
    """
    # Quarters, so that the distance of any two 64-bit numbers fits.
    place = F.shiftright(F.col(order).cast("bigint"), 2)
    low, high, n = df.agg(F.min(place), F.max(place), F.count(order)).first()
    if n <= width:
        return F.lit(0).cast("bigint")
    span = -(-(high - low + 1) // cells)
    cell = F.call_function("div", place - F.lit(low), F.lit(span).cast("bigint")).cast("int")
    found = df.where(F.col(order).isNotNull()).groupBy(cell.alias("c")).agg(F.count(order), F.min(place), F.max(place))
    counts = {c: rest for c, *rest in found.collect()}
    firsts, lows, steps, block, held = [], [], [], 0, 0
    for c in range(cells):
        rows, least, most = counts.get(c, (0, 0, 0))
        parts = -(-2 * rows // width)
        if parts > 1 and held:
            block, held = block + 1, 0
        elif held + rows > width:
            block, held = block + 1, 0
        firsts.append(block)
        lows.append(least)
        steps.append(-(-(most - least + 1) // max(parts, 1)))
        if parts > 1:
            block += parts
        else:
            held += rows

    def of_cell(values: list[int]) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), cell)

    return of_cell(firsts) + F.call_function("div", place - of_cell(lows), of_cell(steps))


def with_hash_position(
    df: DataFrame,
    key: str,
    seed: int | str,
    name: str = "ordinal",
    group: Sequence[str] = (),
    rows: int | None = None,
    width: int = BLOCK_ROWS,
) -> DataFrame:
    """0-based position in a seeded shuffle: order by digest of seed and unique key.

    Digests are uniform, so their leading digits cut the order into even blocks: as many
    digits as keep a block of all rows below ``width``. ``df`` is counted for that unless ``rows``
    says how many there are. Blocks that are themselves many are carried in two levels.
    """
    rows = df.count() if rows is None else rows
    digits = next(d for d in range(1, MOST_DIGITS + 1) if d == MOST_DIGITS or 2 * rows <= width * 16**d)
    shuffled = df.withColumn("_digest", digest(seed, F.col(key)))
    lead = F.conv(F.substring("_digest", 1, digits), 16, 10).cast("bigint")
    levels = 1 if 16**digits <= BLOCK_ROWS else 2
    return with_position(shuffled, ["_digest", key], group, name, lead, width, levels).drop("_digest")


def first_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, salts: int = 64
) -> DataFrame:
    """The first k rows of each group.

    Every group is cut by a salt first: each salted part keeps its own first k,
    so the last step sees at most ``salts * k`` rows of a group.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    part = W.partitionBy(*group, "_salt").orderBy(*order)
    whole = W.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_n", F.row_number().over(part))
        .where(F.col("_n") <= k)
        .withColumn("_n", F.row_number().over(whole))
        .where(F.col("_n") <= k)
        .drop("_salt", "_n")
    )


def chunk_of(ordinal: Column, n: int) -> Column:
    """Number of the fixed-size chunk a position falls into."""
    return F.floor(ordinal / F.lit(n)).cast("bigint")
