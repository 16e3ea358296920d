"""Chat renderings for turn tables: one row per turn, no conversation gathered.

``turns(conv_id, turn, role, text)`` with ``turn`` an integer. Pieces in turn
order, joined without a separator, are the rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import prompts as P
from gradeloom.functions.text import strip
from gradeloom.functions.vectors import digest
from gradeloom.operators.positions import running, with_position

CONV, TURN = "conv_id", "turn"


def _with_ends(turns: DataFrame, place: str = TURN) -> DataFrame:
    """What a turn has to know of its conversation: first and last turn, the first
    role, and whether some role is out of order (``_wrong``).

    User turns belong on every second place from the first one after a leading
    system turn, and nothing else does, so counts by parity of the place decide.
    """
    user, odd = F.col("role") == "user", F.col(place) % 2 == 1
    ends = turns.groupBy(CONV).agg(
        F.min(place).alias("_first"),
        F.max(place).alias("_last"),
        F.min_by("role", place).alias("_first_role"),
        F.count_if(user != odd).alias("_misfit_odd"),
        F.count_if(user == odd).alias("_misfit_even"),
    )
    starts_odd = (F.col("_first") + (F.col("_first_role") == "system").cast("int")) % 2 == 1
    misfits = F.when(starts_odd, F.col("_misfit_odd")).otherwise(F.col("_misfit_even"))
    return turns.join(
        ends.select(CONV, "_first", "_last", "_first_role", (misfits > 0).alias("_wrong")), CONV
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """Character range of each piece in the rendered text."""
    sized = pieces.withColumn("_len", F.length("piece").cast("bigint"))
    placed = running(sized, [CONV], [TURN], {"stop": ("sum", F.col("_len"))})
    return placed.withColumn("start", F.col("stop") - F.col("_len")).drop("_len")


def header_pieces(
    turns: DataFrame, begin: str = "", generation: bool = True, suffix: str = ""
) -> DataFrame:
    """Header style: (conv_id, turn, piece, start, stop)."""
    tail = P.HEADER_GENERATION + suffix if generation else ""
    piece = F.concat(
        F.when(F.col(TURN) == F.col("_first"), F.lit(begin)).otherwise(F.lit("")),
        P.header_piece(F.col("role"), F.col("text")),
        F.when(F.col(TURN) == F.col("_last"), F.lit(tail)).otherwise(F.lit("")),
    )
    return _placed(_with_ends(turns).select(CONV, TURN, piece.alias("piece")))


def im_start_pieces(
    turns: DataFrame, generation: bool = True, think_tail: str = P.EMPTY_THINK
) -> DataFrame:
    """im_start style: (conv_id, turn, piece, start, stop)."""
    tail = (P.IM_START_GENERATION if generation else "") + think_tail
    piece = F.concat(
        P.im_start_piece(F.col("role"), F.col("text")),
        F.when(F.col(TURN) == F.col("_last"), F.lit(tail)).otherwise(F.lit("")),
    )
    return _placed(_with_ends(turns).select(CONV, TURN, piece.alias("piece")))


def instruction_pieces(turns: DataFrame, generation: bool = True) -> DataFrame:
    """Instruction style, with ``error`` on every turn of a conversation whose roles
    do not alternate; its pieces are null. Turn numbers may have gaps."""
    turns = with_position(turns, [TURN], [CONV], "_place")
    role, turn = F.col("role"), F.col("_place")
    closing = (turn == F.col("_last")) & (role == "user") & F.lit(generation)
    piece = F.concat(
        P.instruction_piece(role, F.col("text"), turn - F.col("_first")),
        F.when(closing, F.lit(P.RESPONSE_MARK)).otherwise(F.lit("")),
    )
    wrong = F.col("_wrong")
    return _placed(
        _with_ends(turns, "_place").select(
            CONV,
            TURN,
            F.when(~wrong, piece).alias("piece"),
            F.when(wrong, F.lit("roles must alternate")).alias("error"),
        )
    )


def assistant_spans(turns: DataFrame, begin: str = "") -> DataFrame:
    """What a model is trained on: (conv_id, turn, start, stop, mask) in characters.

    ``mask`` is true on the text of each assistant turn and its end mark, false on
    everything else. Spans cover the whole rendered text with a generation header
    at its end; that header belongs to the last turn.
    """
    role, text = F.col("role"), F.col("text")
    front = F.when(F.col(TURN) == F.col("_first"), F.lit(begin)).otherwise(F.lit(""))
    header = F.concat(front, P.header_of(role))
    said = F.concat(strip(text), F.lit("<|eot_id|>"))
    tail = F.when(F.col(TURN) == F.col("_last"), F.lit(P.HEADER_GENERATION)).otherwise(F.lit(""))
    spoken = role == "assistant"
    parts = F.array(
        _part(F.length(header), F.lit(False)),
        _part(F.length(said), spoken),
        _part(F.length(tail), F.lit(False)),
    )
    sized = _with_ends(turns).select(
        CONV,
        TURN,
        parts.alias("_parts"),
        (F.length(header) + F.length(said) + F.length(tail)).cast("bigint").alias("_len"),
    )
    placed = running(sized, [CONV], [TURN], {"_stop": ("sum", F.col("_len"))})
    base = F.col("_stop") - F.col("_len")
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(3)),
        lambda k: F.aggregate(
            F.slice(F.col("_parts"), F.lit(1), k),
            F.lit(0).cast("bigint"),
            lambda acc, p: acc + p["n"],
        ),
    )
    spans = F.transform(
        F.col("_parts"),
        lambda p, i: F.struct(
            (F.get(F.col("_ends"), i) - p["n"] + F.col("_base")).alias("start"),
            (F.get(F.col("_ends"), i) + F.col("_base")).alias("stop"),
            p["mask"].alias("mask"),
        ),
    )
    return (
        placed.withColumns({"_base": base, "_ends": ends})
        .select(CONV, TURN, F.inline(spans))
        .where(F.col("stop") > F.col("start"))
    )


def _part(n: Column, mask: Column) -> Column:
    return F.struct(n.cast("bigint").alias("n"), mask.alias("mask"))


def digest_text(
    df: DataFrame, key: str, text: str, n: int, seed: int | str
) -> DataFrame:
    """n random questions, numbered from 1 and joined by line ends, as one text.

    n is the size of the sample the caller asks for and bounds the text.
    """
    order = digest(seed, 0, F.col(key))
    picked = df.select(order.alias("_order"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    picked = picked.orderBy("_order", "_key").limit(n)
    listed = F.array_sort(F.collect_list(F.struct("_order", "_key", "_text")))
    return picked.agg(
        F.array_join(
            F.transform(
                listed,
                lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q["_text"]),
            ),
            "\n",
        ).alias("questions")
    )
