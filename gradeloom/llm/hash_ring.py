"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``REPLICAS`` places on a ring, digests of its number and a copy's; a row goes to
the first place clockwise from the digest of its key. A shard takes no more rows than its
bound, so with the bounds equal up to one row (``slack`` 0) the counts are at most one
apart, whatever the ring. Rows that a full shard can't take go on clockwise, from place to place,
until a shard has room. A new shard adds places and moves none, so a row moves only if its arc
changes hands or overflows elsewhere.

Rows of one arc overflow as ranges: the rows of an arc have ranks, by digest of key and hash of
row, and the lowest ranks are taken first. What is left at an arc in round r stands r places
ahead of it, one range per place, so all rounds are played on one count per arc: the driver sees
``shards * replicas`` numbers however large the table is, and rows learn shard and slot from
their arc and rank. A slot is what the shard held before the range, plus the place in it.

The only exchange is that of the ranks. An arc is cut into blocks by the leading bits of digest
and row hash, more of them the fuller the fullest arc, so a key that many rows
share (a null one, say) is many blocks; only rows equal in all columns stay together. Everything
is native expressions; the lookup tables are constants of the plan, of bounded size.

Law of the shards: ``rows``, counts at most one apart. Equal texts under different keys are
different rows and may part: a group with a third of all rows could not be kept whole under this law. A
null text has no bytes, an empty table no shards. Null keys are one key. Repeated rows each get a
slot of their own. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import let
from gradeloom.llm.registry import query, table
from gradeloom.operators.positions import BLOCK_ROWS, chunk_of, with_position

SHARDS = 8
REPLICAS = 256
#: Places of a ring: what the driver and every plan hold.
MOST_PLACES = 1 << 16
#: Digests on the ring have 15 hex digits.
DIGITS, BITS = 15, 60
#: Rows of one file of a written shard.
FILE_ROWS = 1 << 20


@dataclass(frozen=True)
class Ring:
    """Places in clockwise order and the shard that owns each."""

    places: list[int]
    owners: list[int]

    @property
    def shards(self) -> int:
        return max(self.owners) + 1


@dataclass(frozen=True)
class Piece:
    """Ranks ``start`` to ``stop`` of an arc lie in a shard, from a slot on."""

    arc: int
    start: int
    stop: int
    shard: int
    slot: int


def digest_number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def number_of_digest(text: Column) -> Column:
    """The same digest as a column."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def ring_of(shards: int = SHARDS, replicas: int = REPLICAS) -> Ring:
    if shards * replicas > MOST_PLACES:
        raise ValueError(f"{shards} shards of {replicas} places are more than {MOST_PLACES}; use fewer places")
    found = sorted((digest_number(f"shard {s}, place {r}"), s) for s in range(shards) for r in range(replicas))
    return Ring([p for p, _ in found], [s for _, s in found])


def numbers(values: list[int]) -> Column:
    """A constant array, written as one text so that the plan stays small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def rank_in(ordered: list[int], value: Column, bits: int) -> Column:
    """How many of the ordered numbers are below ``value``.

    Its leading ``bits`` name a cell and where to look, so a row compares with the few numbers of one cell.
    """
    before = [bisect_left(ordered, cell << (BITS - bits)) for cell in range((1 << bits) + 1)]

    def found(cell: Column) -> Column:
        first = F.get(numbers(before), cell).cast("int")
        after = F.get(numbers(before), cell + 1).cast("int")
        inside = F.slice(numbers(ordered), first + 1, after - first)
        return first + F.size(F.filter(inside, lambda n: n < value))

    return let(found, F.shiftright(value, BITS - bits).cast("int"))


def arc_of(key: Column, ring: Ring) -> Column:
    """Number of the first place clockwise from the key's digest."""
    bits = max(1, ceil(log2(len(ring.places))) + 1)
    place = number_of_digest(F.coalesce(key.cast("string"), F.lit("")))
    below = let(lambda p: rank_in(ring.places, p, bits), place)
    return F.when(below < len(ring.places), below).otherwise(F.lit(0))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: equal up to one, ``1 + slack`` times the rows in all."""
    total = ceil(rows * (1 + slack))
    return [total // shards + (s < total % shards) for s in range(shards)]


def played(ring: Ring, counts: list[int], most: list[int]) -> list[Piece]:
    """Who takes which ranks of each arc: every round all shards take from what stands at their places."""
    n = len(ring.places)
    taken, held = [0] * n, [0] * len(most)
    waiting = [arc for arc in range(n) if counts[arc]]
    pieces, step = [], 0
    while waiting:
        left = []
        for arc in sorted(waiting, key=lambda a: (a + step) % n):
            shard = ring.owners[(arc + step) % n]
            size = min(counts[arc] - taken[arc], most[shard] - held[shard])
            if size:
                pieces.append(Piece(arc, taken[arc], taken[arc] + size, shard, held[shard]))
                taken[arc] += size
                held[shard] += size
            if taken[arc] < counts[arc]:
                left.append(arc)
        waiting, step = left, step + 1
    return pieces


def hashed_row(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed."""
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[df[c] for c in plain]) if plain else F.lit(0).cast("long")


def placed(pieces: list[Piece], arcs: int, arc: Column, rank: Column) -> Column:
    """(shard, slot) of a rank of an arc."""
    ordered = sorted(pieces, key=lambda p: (p.arc, p.start))
    first = [bisect_left([p.arc for p in ordered], a) for a in range(arcs + 1)]

    def found(at: Column) -> Column:
        shard, slot, start = (F.get(numbers([getattr(p, f) for p in ordered]), at) for f in ("shard", "slot", "start"))
        return F.struct(shard.cast("int").alias("shard"), (slot + rank - start).alias("slot"))

    def last_from(begin: Column, end: Column) -> Column:
        starts = F.slice(numbers([p.start for p in ordered]), begin + 1, end - begin)
        return begin + F.size(F.filter(starts, lambda s: s <= rank)) - 1

    begin, end = (F.get(numbers(first), arc + i).cast("int") for i in (0, 1))
    return let(found, let(last_from, begin, end))


def sharded(
    docs: DataFrame,
    key: str = "doc_id",
    shards: int = SHARDS,
    replicas: int = REPLICAS,
    slack: float = 0.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in its shard) to ``docs``.

    Reads ``docs`` twice, once with its key only to count the arcs.
    """
    ring = ring_of(shards, replicas)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    by_arc = docs.select(arc_of(docs[key], ring).alias("arc")).groupBy("arc").count().collect()
    counts = [0] * len(ring.places)
    for arc, n in by_arc:
        counts[arc] = n
    pieces = played(ring, counts, bounds(sum(counts), shards, slack))
    rows = docs.select(
        F.struct(*[docs[c] for c in own]).alias("row"),
        arc_of(docs[key], ring).alias("arc"),
        F.coalesce(number_of_digest(docs[key].cast("string")), F.lit(-1).cast("long")).alias("of_key"),
        hashed_row(docs).alias("of_row"),
    )
    # Digests are uniform: their leading bits cut an arc evenly, and the row's hash cuts what shares a key.
    bits = max(0, ceil(log2(max(1, max(counts) / block_rows))))
    block = F.struct(F.shiftright("of_key", BITS - bits), F.shiftright("of_row", 64 - bits)) if bits else F.lit(0)
    ranked = with_position(rows, ["of_key", "of_row"], ["arc"], "rank", block)
    found = ranked.select("row", placed(pieces, len(counts), F.col("arc"), F.col("rank")).alias("at")) if pieces else (
        ranked.select("row", F.struct(F.lit(0).alias("shard"), F.col("rank").alias("slot")).alias("at"))
    )
    return found.select(*[F.col("row")[c].alias(c) for c in own], "at.shard", "at.slot")


def write_shards(rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """A folder per shard, in files of at most ``file_rows`` rows in slot order."""
    (
        rows.withColumn("_file", chunk_of(F.col("slot"), file_rows))
        .repartition("shard", "_file")
        .sortWithinPartitions("shard", "slot")
        .drop("_file")
        .write.option("maxRecordsPerFile", file_rows)
        .partitionBy("shard")
        .parquet(folder)
    )


@query("op13_hash_ring")
def op13_hash_ring(spark: SparkSession, sf: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return sharded(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
