"""Singular value decomposition and recomposition of matrices stored row by row.

A matrix is ``(name, row, values)``. Tall ones are cut into blocks of rows; each
block is reduced to its triangular factor and the factors are merged in a tree
(tall-skinny QR), so no task holds more than a few blocks of one matrix. Matrices with more
columns than rows are decomposed as their transposes, so that factors have the shorter side.
Left factors are the rows times V over s, which loses orthogonality as singular values
get small; where they do, a second QR of these, of the same kind, restores it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.vectors import upto
from gradeloom.operators.positions import chunk_of
from gradeloom.session import cut_lineage

BLOCK = 4096
FAN_IN = 8
MERGE_NUMBERS = 1 << 26  # entries of the triangles that one task merges; two of them at least
RANK = 1e-14  # singular values below this share of the largest are zero
CONDITION = 1e4  # below it A V / s is orthogonal to some 1e-12, and no second QR is run
TURNED_COLUMNS = 64  # columns that one task turns into rows
BLOCK_GROUP = 64  # row blocks that one task copies a matrix's factors for
PARTS = "name string, part string, row bigint, values array<double>"
BLOCK_ROWS_SCHEMA = "name string, block bigint, row bigint, values array<double>"


def _stack(rows: pd.DataFrame) -> np.ndarray:
    return np.vstack(rows["values"].to_numpy())


def _rows(name: str, part: str, matrix: np.ndarray, first: int = 0) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "name": name,
            "part": part,
            "row": np.arange(first, first + len(matrix), dtype="int64"),
            "values": list(matrix),
        }
    )


def _triangle(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["block", "row"])
    factor = np.linalg.qr(_stack(group), mode="r")
    return pd.DataFrame(
        {
            "name": group["name"].iat[0],
            "block": group["merged"].iat[0],
            "row": np.arange(len(factor), dtype="int64"),
            "values": list(factor),
        }
    )


def _right_factors(group: pd.DataFrame) -> pd.DataFrame:
    name = group["name"].iat[0]
    _, s, vt = np.linalg.svd(_stack(group.sort_values("row")), full_matrices=False)
    return pd.concat([_rows(name, "S", s.reshape(1, -1)), _rows(name, "V", vt.T)])


def _left_rows(rows: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
    """Rows of A V / s; zero beyond the rank."""
    if rows.empty or factors.empty:
        return pd.DataFrame(columns=["name", "block", "row", "values"])
    s = factors.loc[factors["part"] == "S", "values"].iat[0]
    v = _stack(factors[factors["part"] == "V"].sort_values("row"))
    rows = rows.sort_values("row")
    scale = np.divide(1.0, s, out=np.zeros_like(s), where=s > s.max(initial=0.0) * RANK)
    return pd.DataFrame(
        {
            "name": rows["name"].to_numpy(),
            "block": rows["block"].to_numpy(),
            "row": rows["row"].to_numpy(),
            "values": list(_stack(rows) @ v * scale),
        }
    )


def _orthogonal_rows(rows: pd.DataFrame, triangle: pd.DataFrame) -> pd.DataFrame:
    """The rows times the inverse of their triangular factor, whose diagonal is made positive."""
    if rows.empty or triangle.empty:
        return pd.DataFrame(columns=["name", "row", "values"])
    left, factor = _stack(rows), _stack(triangle.sort_values("row"))
    diagonal = np.diagonal(factor)
    rank = int(np.count_nonzero(diagonal))
    signed = factor[:rank, :rank] * np.sign(diagonal[:rank])[:, None]
    left[:, :rank] = np.linalg.solve(signed.T, left[:, :rank].T).T
    return pd.DataFrame({"name": rows["name"].to_numpy(), "row": rows["row"].to_numpy(), "values": list(left)})


def _turned(group: pd.DataFrame) -> pd.DataFrame:
    """A few columns of a matrix as rows of its transpose."""
    columns = _stack(group.sort_values("row")).T
    first = int(group["part"].iat[0]) * TURNED_COLUMNS
    return pd.DataFrame(
        {
            "name": group["name"].iat[0],
            "row": np.arange(first, first + len(columns), dtype="int64"),
            "values": list(columns),
        }
    )


@dataclass(frozen=True)
class Factors:
    """Parts of decomposed matrices; each is computed only where it is used.

    ``left(name, row, values)``, ``singular(name, values)``, ``right(name, row, values)``;
    ``places(name, row)`` are the rows of the matrices, ``floats`` says whether their entries are
    stored in single precision. The first use of a side that the second QR makes runs it.
    """

    places: DataFrame
    floats: bool
    singular: DataFrame
    sides: Callable[[], tuple[DataFrame, DataFrame]]

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return self.sides()

    @property
    def left(self) -> DataFrame:
        return self._sides[0]

    @property
    def right(self) -> DataFrame:
        return self._sides[1]


def _per_block(rows: DataFrame, factors: DataFrame, blocks: int) -> DataFrame:
    """The factors of a matrix once for each of its row blocks.

    The copies of one matrix are made by several tasks, a group of blocks each.
    """
    groups = 1 + blocks // BLOCK_GROUP
    group = (F.col("_block") % groups).cast("int")
    wanted = rows.select(F.col("name").alias("_name"), F.col("block").alias("_block")).distinct()
    dealt = factors.withColumn("_group", F.explode(upto(groups)))
    return (
        dealt.join(wanted.withColumn("_of", group), (F.col("name") == F.col("_name")) & (F.col("_group") == F.col("_of")))
        .select(F.col("_name").alias("name"), F.col("_block").alias("block"), "part", "row", "values")
    )


def _blocks(rows: DataFrame) -> int:
    """Row blocks of the tallest matrix."""
    return (rows.agg(F.max("block")).first()[0] or 0) + 1


def _merged_triangles(factors: DataFrame, blocks: int, columns: int) -> DataFrame:
    """One triangular factor per matrix, from those of its blocks (name, block, row, values).

    Wide triangles are merged two by two, narrow ones by up to ``FAN_IN``.
    """
    fan_in = max(2, min(FAN_IN, MERGE_NUMBERS // max(1, columns * columns)))
    while blocks > 1:
        factors = (
            factors.withColumn("merged", chunk_of(F.col("block"), fan_in))
            .groupBy("name", "merged")
            .applyInPandas(_triangle, BLOCK_ROWS_SCHEMA)
        )
        blocks = -(-blocks // fan_in)
    return factors


def _block_triangles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("merged", F.col("block")).groupBy("name", "merged").applyInPandas(_triangle, BLOCK_ROWS_SCHEMA)


def _transposed(rows: DataFrame) -> DataFrame:
    """Transposes of matrices stored row by row; a task holds ``TURNED_COLUMNS`` columns of one."""
    width = TURNED_COLUMNS
    starts = upto(F.ceil(F.size("values") / width))
    parts = F.transform(starts, lambda p: F.slice("values", p * width + 1, F.lit(width)))
    sliced = rows.select("name", "row", F.posexplode(parts).alias("part", "values"))
    return sliced.groupBy("name", "part").applyInPandas(_turned, "name string, row bigint, values array<double>")


def decompose(matrices: DataFrame, block_rows: int = BLOCK) -> Factors:
    """Left and right factors and singular values of every matrix.

    Columns beyond the rank carry a zero singular value. Signs are arbitrary, as always.
    """
    given = matrices.select("name", "row", F.col("values").cast("array<double>").alias("values"))
    shapes = given.groupBy("name").agg((F.max("row") + 1).alias("rows"), F.max(F.size("values")).alias("columns"))
    height, columns, turned = shapes.agg(
        F.max(F.greatest("rows", "columns")), F.max(F.least("rows", "columns")), F.count_if(F.col("columns") > F.col("rows"))
    ).first()
    blocks = max(1, -(-(height or 0) // block_rows))
    wide = shapes.where(F.col("columns") > F.col("rows")).select("name")
    upright = given
    if turned:
        upright = given.join(wide, "name", "left_anti").unionByName(_transposed(given.join(wide, "name", "left_semi")))
    rows = cut_lineage(upright.withColumn("block", chunk_of(F.col("row"), block_rows)))
    triangles = _merged_triangles(_block_triangles(rows), blocks, columns or 0)
    factors = cut_lineage(triangles.groupBy("name").applyInPandas(_right_factors, PARTS))

    singular = factors.where("part = 'S'").select("name", "values")

    def sides() -> tuple[DataFrame, DataFrame]:
        raw = (
            rows.groupBy("name", "block")
            .cogroup(_per_block(rows, factors, blocks).groupBy("name", "block"))
            .applyInPandas(_left_rows, BLOCK_ROWS_SCHEMA)
        )
        left = raw.select("name", "row", "values")
        most = F.array_max("values")
        small = F.exists("values", lambda s: (s > most * RANK) & (s * CONDITION < most))
        if not singular.where(small).isEmpty():
            # Stored, because the triangle is that of these very numbers.
            raw = cut_lineage(raw)
            triangle = _merged_triangles(_block_triangles(raw), blocks, columns).select(
                "name", F.lit("R").alias("part"), "row", "values"
            )
            left = (
                raw.groupBy("name", "block")
                .cogroup(_per_block(raw, triangle, blocks).groupBy("name", "block"))
                .applyInPandas(_orthogonal_rows, "name string, row bigint, values array<double>")
            )
        right = factors.where("part = 'V'").select("name", "row", "values")
        if not turned:
            return left, right

        def chosen(own: DataFrame, other: DataFrame) -> DataFrame:
            return own.join(wide, "name", "left_anti").unionByName(other.join(wide, "name", "left_semi"))

        return chosen(left, right), chosen(right, left)

    floats = matrices.schema["values"].dataType.simpleString() == "array<float>"
    return Factors(given.select("name", "row"), floats, singular, sides)


def _compose_rows(rows: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
    out_columns = ["name", "row", "values", "degenerate"]
    if rows.empty or factors.empty:
        return pd.DataFrame(columns=out_columns)
    s = factors.loc[factors["part"] == "S", "values"].iat[0]
    mask = factors.loc[factors["part"] == "M", "values"].iat[0]
    v = _stack(factors[factors["part"] == "V"].sort_values("row"))
    weighted = s * mask
    degenerate = bool(weighted.sum() == 0)
    if degenerate:
        values = [None] * len(rows)
    else:
        scaled = weighted * (s.sum() / weighted.sum())
        values = list((_stack(rows) * scaled) @ v.T)
    return pd.DataFrame(
        {
            "name": rows["name"].to_numpy(),
            "row": rows["row"].to_numpy(),
            "values": values,
            "degenerate": degenerate,
        }
    )


def compose(parts: Factors, masks: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """``U diag(S * mask) V^T * sum(S) / sum(S * mask)`` row by row, per name.

    ``masks(name, values)`` has one entry per singular value. When the masked
    singular values sum to zero the rows are null and ``degenerate`` is set.
    """
    rows = parts.left.withColumn("block", chunk_of(F.col("row"), block_rows))

    def as_part(df: DataFrame, part: str) -> DataFrame:
        row = F.col("row") if "row" in df.columns else F.lit(0).cast("bigint")
        values = F.col("values").cast("array<double>").alias("values")
        return df.select("name", F.lit(part).alias("part"), row.alias("row"), values)

    factors = as_part(parts.singular, "S").unionByName(as_part(parts.right, "V")).unionByName(as_part(masks, "M"))
    # The blocks of a matrix are known from its row numbers; U need not be made for that.
    places = parts.places.withColumn("block", chunk_of(F.col("row"), block_rows))
    return (
        rows.groupBy("name", "block")
        .cogroup(_per_block(places, factors, _blocks(places)).groupBy("name", "block"))
        .applyInPandas(
            _compose_rows, "name string, row bigint, values array<double>, degenerate boolean"
        )
    )


def apply_composed(base: DataFrame, composed: DataFrame, part: str = "mlp") -> DataFrame:
    """Composed rows for the chosen names, the base rows for all others."""
    chosen = composed.where(F.col("name").contains(part)).select(
        "name", "row", F.col("values").alias("_new")
    )
    return base.join(chosen, ["name", "row"], "left").select(
        "name", "row", F.coalesce("_new", "values").alias("values")
    )


def reconstruct(parts: Factors, block_rows: int = BLOCK) -> DataFrame:
    """``U diag(S) V^T``: composing with a mask of ones.

    Entries stored in single precision come back in it, so the last bits that the factors
    lose in double precision go and the entries are those given.
    """
    ones = parts.singular.select("name", F.transform("values", lambda _: F.lit(1.0)).alias("values"))
    again = compose(parts, ones, block_rows).drop("degenerate")
    return again.withColumn("values", F.col("values").cast("array<float>")) if parts.floats else again
