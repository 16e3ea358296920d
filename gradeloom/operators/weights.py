"""Tables of named vectors: masks, mixes, neighbour averaging over a contact graph.

Vectors are ``array<double>``. Sums over many vectors work on slices of
``SLICE`` entries with one aggregate per entry: partial sums run before the
shuffle and no row per entry is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.vectors import gaussian, sigmoid_mask, upto
from gradeloom.operators.positions import running
from gradeloom.session import cut_lineage

SLICE = 64


def choose_params(params: DataFrame, part: str = "mlp", unlike: str | None = None) -> DataFrame:
    """Vectors whose name contains ``part`` (and not ``unlike``)."""
    kept = params.where(F.col("name").contains(part))
    return kept if unlike is None else kept.where(~F.col("name").contains(unlike))


def sliced(params: DataFrame, values: str = "values") -> DataFrame:
    """One row per slice: ``slice`` and a part of at most SLICE entries."""
    vector = F.col(values)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vector) / SLICE) - 1, F.lit(0)).cast("int"))
    parts = F.transform(starts, lambda s: F.slice(vector, s * SLICE + 1, F.lit(SLICE)))
    rest = [c for c in params.columns if c != values]
    return params.select(*rest, F.posexplode(parts).alias("slice", values))


def entry_sums(
    df: DataFrame, keys: Sequence[str], values: str, weight: Column | None = None, **more: Column
) -> DataFrame:
    """Entry-wise (weighted) sum of sliced vectors per key and slice, with further aggregates."""
    factor = F.lit(1.0) if weight is None else weight
    sums = [F.sum(F.get(F.col(values), F.lit(i)) * factor) for i in range(SLICE)]
    longest = F.max(F.size(values)).alias("_n")
    added = df.groupBy(*keys, "slice").agg(
        F.array(*sums).alias(values), longest, *[agg.alias(k) for k, agg in more.items()]
    )
    return added.withColumn(values, F.slice(values, F.lit(1), F.col("_n"))).drop("_n")


def unsliced(df: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """Whole vectors again; a group is the slices of one vector."""
    parts = F.array_sort(F.collect_list(F.struct("slice", values)))
    return df.groupBy(*keys).agg(F.flatten(parts[values]).alias(values))


def masked(params: DataFrame, max_mult: float = 1.0, values: str = "values") -> DataFrame:
    return params.withColumn(values, sigmoid_mask(F.col(values), max_mult))


def init_vectors(
    shapes: DataFrame, value: float, seed: int | str, spread: float = 0.01
) -> DataFrame:
    """Start vectors ``value + spread * gaussian`` of length ``least(rows, cols)`` per name."""
    index = upto(F.least("rows", "cols"))
    filled = F.transform(
        index, lambda i: F.lit(float(value)) + F.lit(spread) * gaussian(seed, F.col("name"), i)
    )
    return shapes.select("name", filled.alias("values"))


def default_coefficients(names: DataFrame, experts: Sequence[int]) -> DataFrame:
    """Weight 1/n for each of the n experts and every name."""
    listed = F.array(*[F.lit(e) for e in experts])
    return names.select(
        F.explode(listed).alias("expert"), "name", F.lit(1.0 / len(experts)).alias("weight")
    )


def normalized_coefficients(coefficients: DataFrame) -> DataFrame:
    """Weights divided by their sum over the experts, name by name."""
    sums = coefficients.groupBy("name").agg(F.sum("weight").alias("_sum"))
    return coefficients.join(sums, "name").select(
        "expert", "name", (F.col("weight") / F.nullif(F.col("_sum"), F.lit(0.0))).alias("weight")
    )


def mixed(params: DataFrame, coefficients: DataFrame, shared: bool = False) -> DataFrame:
    """Weighted sum over the experts, per name.

    ``params(expert, name, values)``; ``coefficients(expert, name, weight)`` or,
    when shared by all names, ``(expert, weight)``.
    """
    joined = sliced(params).join(coefficients, ["expert"] if shared else ["expert", "name"])
    return unsliced(entry_sums(joined, ["name"], "values", F.col("weight")), ["name"])


def exchanged(
    params: DataFrame, edges: DataFrame, coefficient: float = 0.5, salts: int = 16
) -> DataFrame:
    """One exchange: every node moves toward its neighbours.

    ``local + coefficient / (k + 1) * sum(neighbour - local)`` over its k
    neighbours, all read from the state before the exchange; a node without
    neighbours keeps its vectors. ``params(node, name, values)``,
    ``edges(node, neighbour)``.

    A node that many others hear is small on both sides of the join and large in
    its result, so its slices are spread over ``salts`` join keys and every edge
    is repeated for each of them.
    """
    salt = F.pmod(F.xxhash64("name", "slice"), F.lit(salts))
    sent = sliced(params).withColumnRenamed("node", "neighbour").withColumn("_salt", salt)
    links = edges.where(F.col("neighbour").isNotNull()).select(
        "node",
        "neighbour",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"),
    )
    heard = entry_sums(
        links.join(sent, ["neighbour", "_salt"]), ["node", "name"], "values", _k=F.count(F.lit(1))
    )
    heard = unsliced_with(heard, ["node", "name"], "values", "_k").withColumnRenamed("values", "_sum")
    step = F.lit(float(coefficient)) / (F.col("_k") + 1)
    moved = F.zip_with("values", "_sum", lambda v, s: v + step * (s - F.col("_k") * v))
    return params.join(heard, ["node", "name"], "left").select(
        *[
            F.when(F.col("_k").isNull(), F.col("values")).otherwise(moved).alias("values")
            if c == "values"
            else F.col(c)
            for c in params.columns
        ]
    )


def unsliced_with(df: DataFrame, keys: Sequence[str], values: str, extra: str) -> DataFrame:
    """Whole vectors with one column that is equal in all their slices."""
    parts = F.array_sort(F.collect_list(F.struct("slice", values)))
    return df.groupBy(*keys).agg(F.flatten(parts[values]).alias(values), F.max(extra).alias(extra))


def exchange_rounds(
    params: DataFrame,
    edges: DataFrame,
    rounds: int,
    coefficient: float = 0.5,
    between: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Several exchanges over ``edges(round, node, neighbour)``.

    Every round starts from a checkpointed state: the plan stays as small as one
    round and a lost executor costs one round at most. ``between`` may replace
    the state before a round, as training between exchanges does.
    """
    state = params
    for number in range(rounds):
        if between is not None:
            state = between(state, number)
        now = edges.where(F.col("round") == number)
        state = cut_lineage(exchanged(state, now, coefficient))
    return state


#: Entries of a slice of a flat vector.
FLAT_SLICE = 1024


def _whole(value: Column, width: int) -> Column:
    """Whole part of a division, exact for all whole numbers."""
    return F.call_function("div", value, F.lit(width).cast("bigint"))


def _slices_of(first: Column, n: Column, width: int) -> Column:
    """Numbers of the slices that n > 0 entries from ``first`` on lie in."""
    return F.sequence(_whole(first, width), _whole(first + n - 1, width))


def _offsets(sized: DataFrame) -> DataFrame:
    """``_from``: the entries of an owner before each of its vectors, from their number ``_n``."""
    total = {"_before": ("sum", F.col("_n"))}
    placed = running(sized, ["owner"], ["position"], total, inclusive=False)
    return placed.withColumn("_from", F.coalesce(F.col("_before"), F.lit(0).cast("bigint"))).drop("_before")


def flattened(params: DataFrame, width: int = FLAT_SLICE) -> DataFrame:
    """All vectors of an owner in one numbering: pieces (owner, name, first, values).

    ``params(owner, position, name, values)`` with ``position`` the 0-based
    place of the vector in its owner's parameter order. A vector is cut where a slice of
    ``width`` entries of the flat numbering ends, so every piece lies in one slice. An empty
    vector has no piece.
    """
    placed = _offsets(params.withColumn("_n", F.size("values").cast("bigint")))
    start, end = F.col("_from"), F.col("_from") + F.col("_n")

    def piece(number: Column) -> Column:
        first, last = F.greatest(start, number * width), F.least(end, (number + 1) * width)
        part = F.slice("values", (first - start + 1).cast("int"), (last - first).cast("int"))
        return F.struct(first.alias("first"), part.alias("values"))

    pieces = F.transform(_slices_of(start, F.col("_n"), width), piece)
    return placed.where("_n > 0").select("owner", "name", F.inline(pieces))


def split_by_sizes(flat: DataFrame, sizes: DataFrame, width: int = FLAT_SLICE) -> DataFrame:
    """Named vectors again, from pieces ``flat(owner, first, values)`` and ``sizes(owner, position, name, n)``.

    Pieces that lie in one slice each, as :func:`flattened` cuts them, and leave no gap. They are put
    together slice by slice, and a vector takes its part of every slice it lies in, so many
    short vectors in one slice cost no more than a long one. A vector of length zero comes back empty.
    """
    placed = _offsets(sizes.withColumn("_n", F.col("n").cast("bigint")))
    # An empty vector asks for a slice that does not exist.
    wanted = F.when(F.col("_n") > 0, _slices_of(F.col("_from"), F.col("_n"), width)).otherwise(
        F.array(F.lit(-1).cast("bigint"))
    )
    places = placed.select("owner", "position", "name", "_from", "_n", F.explode(wanted).alias("_slice"))
    pieces = F.array_sort(F.collect_list(F.struct("first", "values")))
    slices = flat.groupBy("owner", _whole(F.col("first"), width).alias("_slice")).agg(
        F.min("first").alias("_first"), F.flatten(pieces["values"]).alias("_values")
    )
    first = F.greatest("_from", "_first")
    last = F.least(F.col("_from") + F.col("_n"), F.col("_first") + F.size("_values"))
    part = F.slice("_values", (first - F.col("_first") + 1).cast("int"), (last - first).cast("int"))
    met = places.join(slices, ["owner", "_slice"], "left").select(
        "owner", "position", "name", F.struct("_slice", F.coalesce(part, F.array().cast("array<double>")).alias("part")).alias("_part")
    )
    parts = F.array_sort(F.collect_list("_part"))
    return met.groupBy("owner", "position", "name").agg(F.flatten(parts["part"]).alias("values"))
